"""Grid description carried beside a cell table, and the D8 code table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: D8 codes, (row, column) steps, in tie-break order E SE S SW W NW N NE.
D8 = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))


@dataclass(frozen=True)
class GridMeta:
    """Rows, columns, cell sizes and origin of a dense grid; row 0 is north."""

    rows: int
    cols: int
    dx: float = 1.0
    dy: float = 1.0
    x0: float = 0.0
    y0: float = 0.0

    @property
    def diagonal(self) -> float:
        return (self.dx * self.dx + self.dy * self.dy) ** 0.5

    def step(self, dr: int, dc: int) -> float:
        return self.diagonal if dr and dc else self.dy if dr else self.dx


def meta_of(cells: DataFrame, **sizes: float) -> GridMeta:
    """Extent of a dense cell table, by one aggregate."""
    r, c = cells.agg(F.max("r"), F.max("c")).first()
    return GridMeta((r if r is not None else -1) + 1, (c if c is not None else -1) + 1, **sizes)
