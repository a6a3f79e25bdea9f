"""Cell-wise operators and class maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_transform(acc: Column) -> Column:
    return F.log10(acc + 1.0)


def reclassify(value: Column, breaks: list[float], values: list[float]) -> Column:
    """values[i] for breaks[i] <= value < breaks[i+1], the last bin open; 0 below the first."""
    out = F.lit(0.0)
    for b, v in zip(breaks, values, strict=True):
        out = F.when(value >= b, F.lit(v)).otherwise(out)
    return F.when(value.isNotNull(), out)


def mask(value: Column, where: Column, fill: Column) -> Column:
    return F.when(where, fill).otherwise(value)


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    return F.coalesce(F.when(b != 0, a / F.when(b != 0, b)), F.lit(fill))


#: Names of the D8 codes.
DIRECTIONS = {1: "E", 2: "SE", 4: "S", 8: "SW", 16: "W", 32: "NW", 64: "N", 128: "NE"}


def direction_class(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in DIRECTIONS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


#: The break of the two accumulation classes, as a share of the maximum.
ACCUMULATION_BREAK = (1500, 3394716)


def accumulation_class(acc: DataFrame) -> DataFrame:
    """class 0 below or at the break, 1 above; break_at rounded to tens above 100."""
    raw = F.max("acc") * F.lit(float(ACCUMULATION_BREAK[0])) / F.lit(float(ACCUMULATION_BREAK[1]))
    top = acc.agg(raw.alias("b")).select(F.when(F.col("b") > 100, F.rint(F.col("b") / 10) * 10).when(F.col("b") > 10, F.rint("b")).otherwise(F.col("b")).alias("break_at"))
    return acc.crossJoin(F.broadcast(top)).select("r", "c", F.when(F.col("acc") > F.col("break_at"), 1).when(F.col("acc").isNotNull(), 0).alias("class"))


#: Labels and colours of the two stream classes.
STREAM_CLASSES = {0: "No Stream", 1: "Stream"}


def stream_class(stream: Column) -> Column:
    """1 on a stream, 0 off it, NULL for NoData."""
    return F.when(stream > 0, 1).when(stream.isNotNull(), 0)


def order_class(order: Column) -> Column:
    return F.least(order, F.lit(10))


def watershed_hue(label: Column) -> Column:
    return F.pmod(label * 137, F.lit(360))


def slope_class(slopes: DataFrame, classes: int = 9) -> DataFrame:
    """1..classes by equal intervals from max(0, min) to max."""
    ends = slopes.agg(F.greatest(F.lit(0.0), F.min("slope")).alias("lo"), F.max("slope").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / float(classes)
    k = F.least(F.floor((F.col("slope") - F.col("lo")) / F.when(width > 0, width)) + 1, F.lit(classes))
    return slopes.crossJoin(F.broadcast(ends)).select("r", "c", F.when(F.col("slope").isNotNull(), F.greatest(F.coalesce(k, F.lit(1)), F.lit(1))).cast("int").alias("class"))


#: Upper bounds of the aspect classes (flat, N, NE, E, SE, S, SW, W, NW, N).
ASPECT_BOUNDS = (-0.5, 22.5, 67.5, 112.5, 157.5, 202.5, 247.5, 292.5, 337.5, 360.0)


def aspect_class(aspect: Column) -> Column:
    out = F.lit(len(ASPECT_BOUNDS))
    for k in range(len(ASPECT_BOUNDS) - 1, 0, -1):
        out = F.when(aspect <= ASPECT_BOUNDS[k - 1], k).otherwise(out)
    return F.when(aspect.isNotNull(), out)


def ramp_position(cells: DataFrame) -> DataFrame:
    """Position 0..1 of each elevation in the grid's range, and the quarter it falls in."""
    ends = cells.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    t = (F.col("z") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    return cells.crossJoin(F.broadcast(ends)).select("r", "c", t.alias("position"), F.least(F.floor(t * 4), F.lit(3)).cast("int").alias("quarter"))
