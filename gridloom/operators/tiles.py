"""Tiles with a halo: a user function over blocks of a grid (the generic array escape hatch)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import GridMeta


def with_halo(cells: DataFrame, tile: int, halo: int, meta: GridMeta) -> DataFrame:
    """Cells with the tile (tr, tc) that reads them; cells near an edge go to the neighbour
    tiles as well. own tells the tile that writes a cell."""
    tr, tc = F.floor(F.col("r") / tile).cast("int"), F.floor(F.col("c") / tile).cast("int")
    last_r, last_c = (meta.rows - 1) // tile, (meta.cols - 1) // tile

    def spans(at, last):
        low = F.greatest(F.floor((F.col(at) - halo) / tile).cast("int"), F.lit(0))
        high = F.least(F.floor((F.col(at) + halo) / tile).cast("int"), F.lit(last))
        return F.sequence(low, high)

    spread = cells.withColumn("tr", F.explode(spans("r", last_r))).withColumn("tc", F.explode(spans("c", last_c)))
    return spread.withColumn("own", (F.col("tr") == tr) & (F.col("tc") == tc))


def dense(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """The tile's cells as an array (NaN where none or NULL), and its first row and column."""
    r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
    out = np.full((int(pdf["r"].max()) - r0 + 1, int(pdf["c"].max()) - c0 + 1), np.nan)
    out[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = pdf[value].to_numpy(dtype=float, na_value=np.nan)
    return out, r0, c0


def focal(cells: DataFrame, meta: GridMeta, fn: Callable[[np.ndarray], np.ndarray], halo: int, name: str, value: str = "z", nearest: bool = False, tile: int = 128) -> DataFrame:
    """r, c, name: fn over each tile's array with `halo` cells around it on every side; fn
    returns the inner part, NaN for NULL. Outside the grid there is NaN, or the nearest cell.

    The grid is shuffled once, with the halo (some 4 * halo / tile more cells).
    """

    def run(key: tuple[int, int], pdf: pd.DataFrame) -> pd.DataFrame:
        (top, left), own = (k * tile for k in key), pdf["own"].to_numpy()
        rows, cols = min(tile, meta.rows - top), min(tile, meta.cols - left)
        a = np.full((rows + 2 * halo, cols + 2 * halo), np.nan)
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        a[r - top + halo, c - left + halo] = pdf[value].to_numpy(dtype=float, na_value=np.nan)
        if nearest:
            inside = (np.clip(np.arange(at - halo, at + n + halo), 0, size - 1) - at + halo for at, n, size in ((top, rows, meta.rows), (left, cols, meta.cols)))
            a = a[np.ix_(*inside)]
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.asarray(fn(a), dtype=float)[r[own] - top, c[own] - left]
        return pd.DataFrame({"r": r[own], "c": c[own], name: pd.arrays.FloatingArray(np.nan_to_num(out), np.isnan(out))})

    return with_halo(cells.select("r", "c", value), tile, halo, meta).groupBy("tr", "tc").applyInPandas(run, f"r int, c int, {name} double")


def shifted(a: np.ndarray, halo: int, dr: int, dc: int) -> np.ndarray:
    """The inner part of an array with a halo, moved by (dr, dc)."""
    rows, cols = a.shape
    return a[halo + dr : rows - halo + dr, halo + dc : cols - halo + dc]


def map_tiles(cells: DataFrame, meta: GridMeta, fn: Callable[[np.ndarray], np.ndarray], tile: int = 256, halo: int = 1, value: str = "z", name: str = "out") -> DataFrame:
    """r, c, out: fn over each tile's array with its halo; fn keeps the array's shape."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, r0, c0 = dense(pdf, value)
        own = pdf[pdf["own"]]
        v = np.asarray(fn(a), dtype=float)[own["r"].to_numpy() - r0, own["c"].to_numpy() - c0]
        return pd.DataFrame({"r": own["r"].to_numpy(), "c": own["c"].to_numpy(), name: pd.Series(v).astype(object).where(~np.isnan(v), None)})

    return with_halo(cells.select("r", "c", value), tile, halo, meta).groupBy("tr", "tc").applyInPandas(run, f"r int, c int, {name} double")
