"""Neighbourhoods of a dense cell grid by window passes over rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import D8, GridMeta

NAMES = {(-1, -1): "nw", (-1, 0): "n", (-1, 1): "ne", (0, -1): "w", (0, 1): "e", (1, -1): "sw", (1, 0): "s", (1, 1): "se"}


def neighbours(cells: DataFrame, value: str = "z", nearest: bool = True) -> DataFrame:
    """Adds nw n ne w e sw s se. Outside the grid: the nearest cell's value, or NULL.

    A row pass packs west, own and east into one struct; a column pass fetches that struct
    from above and below. Two shuffles for eight neighbours, no join.
    """
    along, down_ = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    own = F.struct(F.col(value).alias("v"))
    west, east = F.lag(own).over(along), F.lead(own).over(along)
    if nearest:
        west, east = F.coalesce(west, own), F.coalesce(east, own)
    packed = cells.withColumn("_row", F.struct(west["v"].alias("w"), F.col(value).alias("o"), east["v"].alias("e")))
    up, down = F.lag("_row").over(down_), F.lead("_row").over(down_)
    if nearest:
        up, down = F.coalesce(up, F.col("_row")), F.coalesce(down, F.col("_row"))
    both = packed.withColumn("_up", up).withColumn("_down", down)
    fields = {"nw": "_up.w", "n": "_up.o", "ne": "_up.e", "w": "_row.w", "e": "_row.e", "sw": "_down.w", "s": "_down.o", "se": "_down.e"}
    return both.withColumns({k: F.col(v) for k, v in fields.items()}).drop("_row", "_up", "_down")


def around() -> list[Column]:
    """The eight neighbour columns in D8 order."""
    return [F.col(NAMES[dr, dc]) for _, dr, dc in D8]


def framed(cells: DataFrame, value: str, k: int, meta: GridMeta, padded: bool = True) -> DataFrame:
    """Adds _n, _sum, _sq, _min, _max, _bad of the (2k+1) x (2k+1) window around each cell.

    padded: the grid's edge cells repeat outward (a weight on the first and last value of a
    frame); otherwise the window is cut at the edge. _bad counts NULLs, which the other
    statistics skip. Separable: a pass along rows, then one along columns.
    """

    def one_pass(df, key, at, size, ins):
        line = Window.partitionBy(key).orderBy(at)
        frame, whole = line.rowsBetween(-k, k), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before, after = F.greatest(F.lit(0), F.lit(k) - F.col(at)), F.greatest(F.lit(0), F.lit(k) - (F.lit(size - 1) - F.col(at)))
        out = {}
        for name, (expr, kind) in ins.items():
            if kind == "sum":
                total = F.sum(expr).over(frame)
                if padded:
                    total = total + before * F.first(expr).over(whole) + after * F.last(expr).over(whole)
                out[name] = total
            else:
                out[name] = (F.min if kind == "min" else F.max)(expr).over(frame)
        return df.withColumns(out)

    v = F.col(value)
    zero = F.coalesce(v, F.lit(0.0))
    first = {"_n": (F.when(v.isNotNull(), 1).otherwise(0), "sum"), "_bad": (F.when(v.isNull(), 1).otherwise(0), "sum"), "_sum": (zero, "sum"), "_sq": (zero * zero, "sum"), "_min": (v, "min"), "_max": (v, "max")}
    kinds = {name: kind for name, (_, kind) in first.items()}
    once = one_pass(cells, "r", "c", meta.cols, first)
    return one_pass(once, "c", "r", meta.rows, {name: (F.col(name), kind) for name, kind in kinds.items()})


def offset_join(cells: DataFrame, offsets: list[tuple[int, int]], value: str, meta: GridMeta, nearest: bool) -> DataFrame:
    """One row per cell and offset with the neighbour's value as _v (for non-separable windows).

    The offset list is a literal array; neighbours outside the grid are the nearest cell or
    left out.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(offsets)])
    r, c = F.col("r") + F.col("_o.dr"), F.col("c") + F.col("_o.dc")
    spread = cells.withColumn("_o", F.explode(pairs))
    if nearest:
        r, c = F.greatest(F.lit(0), F.least(F.lit(meta.rows - 1), r)), F.greatest(F.lit(0), F.least(F.lit(meta.cols - 1), c))
    spread = spread.withColumns({"_r": r, "_c": c})
    there = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).alias("_v"))
    return spread.join(there, ["_r", "_c"]).withColumn("_k", F.col("_o.k")).drop("_o", "_r", "_c")
