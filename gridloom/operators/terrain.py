"""Terrain derivatives: gradients, curvature, focal statistics, landforms.

NoData is NULL and stays NULL; border cells of slope are NULL (no in-band markers).
"""

from __future__ import annotations

from functools import reduce
from math import radians

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import GridMeta
from . import stencil, tiles


def _sobel(dx: float, dy: float, hole: bool) -> tuple[Column, Column]:
    """West minus east and north minus south differences; hole: NULL counts as 0."""
    v = {k: F.coalesce(F.col(k), F.lit(0.0)) if hole else F.col(k) for k in stencil.NAMES.values()}
    east = ((v["nw"] + 2 * v["w"] + v["sw"]) - (v["ne"] + 2 * v["e"] + v["se"])) / (8.0 * dx)
    north = ((v["nw"] + 2 * v["n"] + v["ne"]) - (v["sw"] + 2 * v["s"] + v["se"])) / (8.0 * dy)
    return east, north


def _inner(meta: GridMeta) -> Column:
    return (F.col("r") > 0) & (F.col("c") > 0) & (F.col("r") < meta.rows - 1) & (F.col("c") < meta.cols - 1)


def slope(cells: DataFrame, meta: GridMeta, units: str = "degrees", z_factor: float = 1.0, name: str = "slope") -> DataFrame:
    """Horn slope; units: degrees, percent or radians."""
    near = stencil.neighbours(cells.select("r", "c", (F.col("z") * z_factor).alias("z")))
    gx, gy = _sobel(meta.dx, meta.dy, hole=True)
    rise = F.atan(F.sqrt(gx * gx + gy * gy))
    value = {"degrees": F.degrees(rise), "percent": F.tan(rise) * 100.0, "radians": rise}[units]
    return near.select("r", "c", F.when(_inner(meta) & F.col("z").isNotNull(), value).alias(name))


def aspect(cells: DataFrame, meta: GridMeta, convention: str = "upslope") -> DataFrame:
    """Compass azimuth of the upslope direction ('downslope': the opposite); -1 where flat."""
    near = stencil.neighbours(cells.select("r", "c", "z"))
    gx, gy = _sobel(meta.dx, meta.dy, hole=False)
    raw = F.lit(90.0) - F.degrees(F.atan2(gy, -gx))
    turned = F.when(raw < 0, raw + 360.0).otherwise(raw)
    if convention == "downslope":
        turned = F.when(turned >= 180.0, turned - 180.0).otherwise(turned + 180.0)
    value = F.when((gx == 0) & (gy == 0), F.lit(-1.0)).otherwise(turned)
    return near.select("r", "c", F.when(F.col("z").isNotNull(), value).alias("aspect"))


def aspect_variance(cells: DataFrame, meta: GridMeta, window: int = 3) -> DataFrame:
    """Circular variance of aspect over non-flat cells of a window cut at the edge."""
    a = aspect(cells, meta)
    live = F.col("aspect") != -1
    k = window // 2
    df = a.withColumns({"_s": F.when(live, F.sin(F.radians("aspect"))).otherwise(F.lit(0.0)), "_c": F.when(live, F.cos(F.radians("aspect"))).otherwise(F.lit(0.0)), "_m": F.when(live, 1).otherwise(0)})
    for key, at in (("r", "c"), ("c", "r")):
        w = Window.partitionBy(key).orderBy(at).rowsBetween(-k, k)
        df = df.withColumns({n: F.sum(n).over(w) for n in ("_s", "_c", "_m")})
    s, c = F.col("_s") / F.col("_m"), F.col("_c") / F.col("_m")
    return df.select("r", "c", F.when(F.col("aspect").isNotNull() & (F.col("_m") > 0), 1.0 - F.sqrt(s * s + c * c)).alias("variance"))


def relative_aspect(cells: DataFrame, meta: GridMeta, azimuth: float = 0.0) -> DataFrame:
    d = F.abs(F.col("aspect") - azimuth)
    return aspect(cells, meta).select("r", "c", F.when(F.col("aspect") != -1, F.when(d > 180, 360.0 - d).otherwise(d)).alias("relative"))


def _shade(azimuth: float, altitude: float, gx: Column, gy: Column, swapped: bool) -> Column:
    s, a = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(gy, -gx)
    turn, up = radians(360.0 - azimuth + 90.0), radians(altitude)
    one, two = (F.sin(s), F.cos(s)) if swapped else (F.cos(s), F.sin(s))
    return F.greatest(F.sin(F.lit(up)) * one + F.cos(F.lit(up)) * two * F.cos(F.lit(turn) - a), F.lit(0.0)) * 255.0


def hillshade(cells: DataFrame, meta: GridMeta, azimuths: tuple[float, ...] = (315.0,), altitude: float = 45.0, z_factor: float = 1.0, convention: str = "default") -> DataFrame:
    """Mean shade over the azimuths. The default form weighs sin(altitude) by sin(slope);
    convention='standard' is the textbook form."""
    near = stencil.neighbours(cells.select("r", "c", (F.col("z") * z_factor).alias("z")))
    gx, gy = _sobel(meta.dx, meta.dy, hole=False)
    total = sum((_shade(a, altitude, gx, gy, convention != "standard") for a in azimuths[1:]), _shade(azimuths[0], altitude, gx, gy, convention != "standard"))
    missing = gx.isNull() | gy.isNull() | F.col("z").isNull()
    return near.select("r", "c", F.when(~missing, total / float(len(azimuths))).alias("shade"))


MULTI_AZIMUTHS = (225.0, 270.0, 315.0, 360.0)


def gradient(cells: DataFrame, meta: GridMeta, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Central differences, one-sided at the border: {value: (east name, south name)}."""
    out = {}
    for v, (gx, gy) in values.items():
        for name, key, at, size in ((gx, "r", "c", meta.dx), (gy, "c", "r", meta.dy)):
            if not name:
                continue
            w = Window.partitionBy(key).orderBy(at)
            before, after = F.lag(F.struct(F.col(v).alias("v"))).over(w), F.lead(F.struct(F.col(v).alias("v"))).over(w)
            own = F.col(v)
            out[name] = F.when(before.isNull(), (after["v"] - own) / size).when(after.isNull(), (own - before["v"]) / size).otherwise((after["v"] - before["v"]) / (2.0 * size))
    return cells.withColumns(out)


CURVATURES = ("plan", "profile", "tangential", "mean", "total", "gaussian", "maximal", "minimal", "horizontal_excess", "vertical_excess", "difference", "accumulation", "curvedness", "unsphericity", "rotor", "shape_index", "ring")


def curvatures(cells: DataFrame, meta: GridMeta, kinds: tuple[str, ...] = CURVATURES) -> DataFrame:
    """Any of the 17 curvature types as columns, from one set of derivatives. 0/0 gives NULL,
    x/0 gives 0."""
    first = gradient(cells.select("r", "c", "z"), meta, {"z": ("gx", "gy")})
    second = gradient(first, meta, {"gx": ("gxx", "gxy1"), "gy": ("gyx1", "gyy")}).withColumn("gxy", 0.5 * (F.col("gxy1") + F.col("gyx1")))
    gx, gy, gxx, gyy, gxy = (F.col(x) for x in ("gx", "gy", "gxx", "gyy", "gxy"))

    def over(a, b):
        return F.when(b != 0, a / b).when(a != 0, F.lit(0.0))

    df = second.withColumn("p", gx * gx + gy * gy).withColumn("q", 1.0 + F.col("p"))
    p, q = F.col("p"), F.col("q")
    df = df.withColumns({"A": gxx * gy * gy - 2.0 * gxy * gx * gy + gyy * gx * gx, "B": gxx * gx * gx + 2.0 * gxy * gx * gy + gyy * gy * gy, "M": (1.0 + gy * gy) * gxx - 2.0 * gx * gy * gxy + (1.0 + gx * gx) * gyy})
    a, b = F.col("A"), F.col("B")
    df = df.withColumns({"H": -F.col("M") / (2.0 * q * F.sqrt(q)), "K": (gxx * gyy - gxy * gxy) / (q * q)})
    h, k = F.col("H"), F.col("K")
    df = df.withColumn("D", F.sqrt(F.greatest(F.lit(0.0), h * h - k)))
    d = F.col("D")
    plan, profile = over(a, p * F.sqrt(q)), over(-b, p * q * F.sqrt(q))
    forms = {
        "plan": plan, "profile": profile, "tangential": plan, "mean": h, "total": gxx + gyy, "gaussian": k, "maximal": h + d, "minimal": h - d,
        "horizontal_excess": over(a, p), "vertical_excess": over(-b, p), "difference": plan - profile, "accumulation": over(a, p) + over(-b, p),
        "curvedness": F.sqrt(((h + d) * (h + d) + (h - d) * (h - d)) / 2.0), "unsphericity": d, "rotor": ((gxx - gyy) * (gxx - gyy) + 4.0 * gxy * gxy) / 4.0,
        "shape_index": F.when(d != 0, F.lit(0.6366197723675814) * F.atan(h / F.when(d != 0, d))), "ring": 2.0 * h * k,
    }
    return df.select("r", "c", *[F.when(F.col("z").isNotNull(), forms[x]).alias(x) for x in kinds])


def _odd(window: int) -> int:
    return window // 2


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (i or j) and i * i + j * j <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i or j]


def tpi(cells: DataFrame, meta: GridMeta, radius: int = 3) -> DataFrame:
    """Elevation less the mean over a disk without its centre; NULL anywhere in it gives NULL."""
    around = disk(radius)

    def run(a: np.ndarray) -> np.ndarray:
        total = sum(tiles.shifted(a, radius, i, j) for i, j in around)
        return tiles.shifted(a, radius, 0, 0) - total / len(around)

    return tiles.focal(cells, meta, run, radius, "tpi", nearest=True)


def tri(cells: DataFrame, meta: GridMeta, radius: int = 1) -> DataFrame:
    """Mean absolute difference to valid neighbours in a window cut at the edge; none gives 0."""

    def run(a: np.ndarray) -> np.ndarray:
        z = tiles.shifted(a, radius, 0, 0)
        total, n = np.zeros(z.shape), np.zeros(z.shape)
        for i, j in square(radius):
            v = np.abs(z - tiles.shifted(a, radius, i, j))
            known = ~np.isnan(v)
            total[known] += v[known]
            n += known
        return np.where(np.isnan(z), np.nan, total / np.maximum(n, 1))

    return tiles.focal(cells, meta, run, radius, "tri")


def focal(cells: DataFrame, meta: GridMeta, statistic: str, window: int = 7, value: str = "z") -> DataFrame:
    """mean, sum, std, min, max, range or median of a padded window; mean, sum and std are
    NULL if the window holds a NULL, the others skip it."""
    k = _odd(window)
    base = cells.select("r", "c", value)
    if statistic == "median":


        def run(a: np.ndarray) -> np.ndarray:
            every = np.sort(np.lib.stride_tricks.sliding_window_view(a, (2 * k + 1, 2 * k + 1)).reshape(a.shape[0] - 2 * k, a.shape[1] - 2 * k, -1), axis=-1)
            n = (~np.isnan(every)).sum(axis=-1, keepdims=True)  # NaN sorts last
            low, high = (np.take_along_axis(every, np.clip(at, 0, every.shape[-1] - 1), axis=-1)[..., 0] for at in ((n - 1) // 2, n // 2))
            return np.where(n[..., 0] > 0, (low + high) / 2, np.nan)

        return tiles.focal(base, meta, run, k, "median", value, nearest=True)
    df = stencil.framed(base, value, k, meta)
    n = float((2 * k + 1) ** 2)
    whole, mean = F.col("_bad") == 0, F.col("_sum") / n
    form = {"mean": F.when(whole, mean), "sum": F.when(whole, F.col("_sum")), "std": F.when(whole, F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") / n - mean * mean))), "min": F.col("_min"), "max": F.col("_max"), "range": F.col("_max") - F.col("_min")}[statistic]
    return df.select("r", "c", form.alias(statistic))


def roughness(cells: DataFrame, meta: GridMeta, window: int = 3) -> DataFrame:
    return focal(cells, meta, "range", window).withColumnRenamed("range", "roughness")


def multiscale_roughness(cells: DataFrame, meta: GridMeta, low: int = 1, high: int = 3) -> DataFrame:
    """Largest roughness over windows 2r+1 for r in low..high."""
    df = cells.select("r", "c", "z")
    for r in range(low, high + 1):
        df = stencil.framed(df, "z", r, meta).withColumn(f"_x{r}", F.col("_max") - F.col("_min")).drop("_n", "_bad", "_sum", "_sq", "_min", "_max")
    return df.select("r", "c", F.greatest(F.lit(0.0), *[F.col(f"_x{r}") for r in range(low, high + 1)]).alias("roughness"))


def hypsometric(cells: DataFrame, meta: GridMeta, window: int = 3) -> DataFrame:
    df = stencil.framed(cells.select("r", "c", "z"), "z", _odd(window), meta)
    n = float((2 * _odd(window) + 1) ** 2)
    spread = F.col("_max") - F.col("_min")
    return df.select("r", "c", F.when(F.col("_bad") == 0, F.when(spread == 0, F.lit(0.5)).otherwise((F.col("_sum") / n - F.col("_min")) / F.when(spread != 0, spread))).alias("hi"))


def relative_position(cells: DataFrame, meta: GridMeta, radius: int = 3, method: str = "minmax") -> DataFrame:
    df = stencil.framed(cells.select("r", "c", "z"), "z", radius, meta)
    n = float((2 * radius + 1) ** 2)
    mean, spread = F.col("_sum") / n, F.col("_max") - F.col("_min")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") / n - mean * mean))
    form = {"minmax": F.when(spread == 0, F.lit(0.5)).otherwise((F.col("z") - F.col("_min")) / F.when(spread != 0, spread)), "diff": F.when(F.col("_bad") == 0, F.col("z") - mean), "dev": F.when(F.col("_bad") == 0, F.when(std == 0, F.lit(0.0)).otherwise((F.col("z") - mean) / F.when(std != 0, std)))}[method]
    return df.select("r", "c", form.alias(method))


def slope_deviation(cells: DataFrame, meta: GridMeta, window: int = 3) -> DataFrame:
    return focal(slope(cells, meta), meta, "std", window, "slope").withColumnRenamed("std", "slope_std")


def edge_density(cells: DataFrame, meta: GridMeta, window: int = 3, threshold: float = 15.0) -> DataFrame:
    steep = slope(cells, meta).select("r", "c", F.when(F.col("slope") > threshold, 1.0).when(F.col("slope").isNotNull(), 0.0).alias("steep"))
    return focal(steep, meta, "mean", window, "steep").withColumnRenamed("mean", "density")


def surface_area_ratio(cells: DataFrame, meta: GridMeta) -> DataFrame:
    return slope(cells, meta, "radians").select("r", "c", (1.0 / F.cos("slope")).alias("ratio"))


def features(cells: DataFrame, meta: GridMeta, kind: str) -> DataFrame:
    """peak, valley or saddle among the eight neighbours of interior cells."""
    near = stencil.neighbours(cells.select("r", "c", "z"), nearest=False)
    higher = sum(((F.when(v > F.col("z"), 1).otherwise(0)) for v in stencil.around()), F.lit(0))
    lower = sum(((F.when(v < F.col("z"), 1).otherwise(0)) for v in stencil.around()), F.lit(0))
    found = {"peak": lower == 8, "valley": higher == 8, "saddle": (higher >= 2) & (lower >= 2)}[kind]
    return near.select("r", "c", F.when(_inner(meta) & F.col("z").isNotNull() & found, 1).otherwise(0).alias(kind))


def ridges(cells: DataFrame, meta: GridMeta, channel: bool = False, threshold: float = 0.1) -> DataFrame:
    p = F.col("profile")
    return curvatures(cells, meta, ("profile",)).select("r", "c", F.when(p < -threshold if channel else p > threshold, 1).otherwise(0).alias("channel" if channel else "ridge"))


def pennock(cells: DataFrame, meta: GridMeta, steep: float = 3.0, curved: float = 0.1) -> DataFrame:
    """Seven landform classes from slope, profile and plan curvature; 0 elsewhere."""
    both = slope(cells, meta).join(curvatures(cells, meta, ("profile", "plan")), ["r", "c"])
    s, f, p = F.col("slope"), F.col("profile"), F.col("plan")
    form = F.when(s.isNull(), 0).when(s < steep, 7).when(f > curved, F.when(p < -curved, 1).when(p > curved, 2).otherwise(0)).when(f < -curved, F.when(p < -curved, 5).when(p > curved, 6).otherwise(0)).when(F.abs(f) <= curved, F.when(p < -curved, 3).when(p > curved, 4).otherwise(0)).otherwise(0)
    return both.select("r", "c", form.alias("landform"))


def directional_relief(cells: DataFrame, meta: GridMeta, azimuth: float = 315.0) -> DataFrame:
    """Rise in the direction of an azimuth: tan(slope) cos(aspect - azimuth); flat gives 0."""
    both = slope(cells, meta, "radians").join(aspect(cells, meta), ["r", "c"])
    value = F.when(F.col("aspect") == -1, F.lit(0.0)).otherwise(F.tan("slope") * F.cos(F.radians("aspect") - radians(azimuth)))
    return both.select("r", "c", F.when(F.col("slope").isNotNull() & F.col("aspect").isNotNull(), value).alias("relief"))


def multiscale(cells: DataFrame, meta: GridMeta, metric: str = "tri", low: int = 1, high: int = 3, step: int = 1) -> DataFrame:
    """Largest TRI, or absolute TPI, over radii low..high."""
    each = []
    for radius in range(low, high + 1, step):
        one = tri(cells, meta, radius) if metric == "tri" else tpi(cells, meta, radius)
        each.append(one.select("r", "c", F.abs(metric).alias("v")))
    return reduce(DataFrame.unionByName, each).groupBy("r", "c").agg(F.greatest(F.lit(0.0), F.max("v")).alias("largest"))
