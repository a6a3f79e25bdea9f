"""Polylines: length, cleaning, endpoint pairs and snapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH = 6371008.8


def _pairs(pts: str, term) -> Column:
    n = F.size(pts)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0.0), lambda s, i: s + term(F.element_at(pts, i), F.element_at(pts, i + 1)))


def length_of(pts: str = "pts", metres: bool = False) -> Column:
    """Planar length of an array of (x, y); metres: great-circle length of degrees."""
    if metres:

        def arc(a, b):
            h = F.pow(F.sin(F.radians(b["y"] - a["y"]) / 2), F.lit(2)) + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), F.lit(2))
            return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

        return _pairs(pts, arc)
    return _pairs(pts, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def clean(lines: DataFrame, least: float = 100.0, metres: bool = False) -> DataFrame:
    """Lines of at least two points and the least length."""
    return lines.withColumn("length", length_of("pts", metres)).filter((F.size("pts") >= 2) & (F.col("length") >= least))


def endpoints(lines: DataFrame) -> DataFrame:
    """id, which (0 start, 1 end), x, y."""
    both = F.array(F.struct(F.lit(0).alias("which"), F.element_at("pts", 1).alias("p")), F.struct(F.lit(1).alias("which"), F.element_at("pts", -1).alias("p")))
    return lines.filter(F.size("pts") >= 2).select("id", F.explode(both).alias("e")).select("id", "e.which", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def _near(e: DataFrame, distance: float) -> DataFrame:
    """All ordered pairs of endpoints (columns id which x y, and id1 which1 x1 y1) nearer than
    distance: a bucketed equi-join, each point asking the 3 x 3 buckets around it."""
    e = e.withColumns({"bx": F.floor(F.col("x") / distance), "by": F.floor(F.col("y") / distance)})
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    ask = e.withColumn("s", F.explode(near)).select(F.col("id").alias("id1"), F.col("which").alias("which1"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("bx") + F.col("s.i")).alias("bx"), (F.col("by") + F.col("s.j")).alias("by"))
    d = F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("y1") - F.col("y")) * (F.col("y1") - F.col("y")))
    return ask.join(e, ["bx", "by"]).withColumn("distance", d).filter(F.col("distance") < distance)


def endpoint_pairs(lines: DataFrame, distance: float) -> DataFrame:
    """Pairs of endpoints of different lines nearer than distance."""
    return _near(endpoints(lines), distance).filter("id1 < id").select("id1", "which1", F.col("id").alias("id2"), F.col("which").alias("which2"), "distance")


def snap_lines(lines: DataFrame, distance: float) -> DataFrame:
    """Lines whose first and last points are those of `snap_endpoints`; other columns as given."""
    moved = snap_endpoints(lines.select("id", "pts"), distance).groupBy("id").agg(
        F.max(F.when(F.col("which") == 0, F.struct("x", "y"))).alias("_a"), F.max(F.when(F.col("which") == 1, F.struct("x", "y"))).alias("_b")
    )
    inner = F.slice("pts", F.lit(2), F.greatest(F.size("pts") - 2, F.lit(0)))
    return lines.join(moved, "id").withColumn("pts", F.concat(F.array("_a"), inner, F.array("_b"))).drop("_a", "_b")


def parts(lines: DataFrame) -> DataFrame:
    """One line for each part (column parts: arrays of points) of two points or more: id, part, pts."""
    return lines.select("id", F.posexplode("parts").alias("part", "pts")).filter(F.size("pts") >= 2)


def connect(lines: DataFrame, snap: float = 50.0, delete_small: bool = True, small: float = 0.0, join: bool = False, unit: str = "map", geographic: bool = False) -> DataFrame:
    """Lines without those shorter than `small` (0: the snap distance); with join, endpoints
    nearer than the snap distance also move to their group's mean."""
    scale = 1.0 / 111320.0 if unit == "metres" and geographic else 1.0
    snap, small = snap * scale, (small if small > 0 else snap) * scale
    some = lines.filter(F.size("pts") >= 2)
    if delete_small:
        some = some.filter(length_of("pts") >= small)
    return snap_lines(some, snap) if join else some


#: Side of a tile and width of its halo, in snap distances.
TILE, HALO = 64, 8
FREE, LEADER, TAKEN = range(3)


def _settle(pdf: pd.DataFrame, side: float, halo: float, distance: float) -> pd.DataFrame:
    """One greedy sweep in endpoint order over a tile's places and those around it; the tile's
    own places with what is certain of them.

    A place is taken by the first leader nearer than distance and leads if there is none. While
    earlier places near it are open, or may lie outside what the tile reads, it stays free; a
    taken place is not settled while an earlier place near it may lead.
    """
    pdf = pdf.sort_values(["key", "x", "y"]).reset_index(drop=True)
    x, y, own = (pdf[n].to_numpy() for n in ("x", "y", "own"))
    reach = halo - 2 * distance
    full = own.copy()
    if reach > 0:
        at = [(v - t * side >= -reach) & (v - t * side < side + reach) for v, t in ((x, int(pdf["tx"].iloc[0])), (y, int(pdf["ty"].iloc[0])))]
        full |= at[0] & at[1]
    bx, by = np.floor(x / distance).astype(np.int64), np.floor(y / distance).astype(np.int64)
    leaders: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
    open_: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
    limit, states, owners, settled = distance * distance, [], [], []
    for k, (px, py, p, q, s, whole) in enumerate(zip(x.tolist(), y.tolist(), bx.tolist(), by.tolist(), pdf["state"].tolist(), full.tolist(), strict=True)):
        near = [(i, j) for i in (p - 1, p, p + 1) for j in (q - 1, q, q + 1)]
        first = -1
        for b in near:
            for o, ox, oy in leaders.get(b, ()):
                if (first < 0 or o < first) and (ox - px) ** 2 + (oy - py) ** 2 < limit:
                    first = o
        known = whole and not any((first < 0 or o < first) and (ox - px) ** 2 + (oy - py) ** 2 < limit for b in near if b in open_ for o, ox, oy in open_[b])
        if s == FREE and first >= 0:
            s = TAKEN
        elif s == FREE and known:
            s = LEADER
        if s == LEADER:
            first = k
            leaders.setdefault((p, q), []).append((k, px, py))
        elif s == FREE:
            open_.setdefault((p, q), []).append((k, px, py))
        states.append(s)
        settled.append(s == LEADER or s == TAKEN and known)
        owners.append(max(first, 0))
    pdf["state"], pdf["settled"] = np.array(states, dtype=np.int32), settled
    pdf["ox"], pdf["oy"] = x[owners], y[owners]
    return pdf.loc[own, ["x", "y", "key", "n", "state", "settled", "ox", "oy"]]


def snap_endpoints(lines: DataFrame, distance: float) -> DataFrame:
    """Endpoints moved to the mean of their group: id, which, x, y.

    Groups form greedily in endpoint order: an unused endpoint takes all unused ones nearer
    than distance. So an endpoint leads unless an earlier leader is near, and belongs to the
    first that is. Endpoints at one place share their fate and are one row. Tiles with a halo
    settle what they can; those with open places are asked again until all are settled (the
    first open place always can be). Endpoints without finite coordinates stay as they are.
    """
    from ..plans.lineage import cut

    side, halo = TILE * distance, HALO * distance
    e = cut(endpoints(lines))
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    places = e.filter(finite).groupBy("x", "y").agg(F.min(F.col("id") * 2 + F.col("which")).alias("key"), F.count(F.lit(1)).alias("n"))

    def home(v):
        return F.floor(F.col(v) / side)

    def spans(v):
        return F.sequence(F.floor((F.col(v) - halo) / side), F.floor((F.col(v) + halo) / side))

    def swept(df, among=None):
        wide = df.select("x", "y", "key", "n", "state").withColumn("tx", F.explode(spans("x"))).withColumn("ty", F.explode(spans("y")))
        wide = wide.withColumn("own", (F.col("tx") == home("x")) & (F.col("ty") == home("y")))
        if among is not None:
            wide = wide.join(among, ["tx", "ty"], "left_semi")
        return wide.groupBy("tx", "ty").applyInPandas(lambda pdf: _settle(pdf, side, halo, distance), "x double, y double, key long, n long, state int, settled boolean, ox double, oy double")

    known = cut(swept(places.withColumn("state", F.lit(FREE))))
    while (again := known.filter("not settled").select(home("x").alias("tx"), home("y").alias("ty")).distinct()).limit(1).count():
        again = cut(again)
        rest = known.withColumns({"tx": home("x"), "ty": home("y")}).join(again, ["tx", "ty"], "left_anti").select(*known.columns)
        known = cut(rest.unionByName(swept(known, again)))
    weight = F.sum("n")
    groups = known.groupBy("ox", "oy").agg(F.count(F.lit(1)).alias("size"), (F.sum(F.col("x") * F.col("n")) / weight).alias("mx"), (F.sum(F.col("y") * F.col("n")) / weight).alias("my"))
    moved = known.join(groups.filter("size > 1"), ["ox", "oy"]).select("x", "y", "mx", "my")
    return e.join(moved, ["x", "y"], "left").select("id", "which", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"))
