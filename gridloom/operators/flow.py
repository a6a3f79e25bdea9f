"""Flow directions, accumulation, lengths, basins, watersheds and indices."""

from __future__ import annotations

from functools import reduce
from math import atan2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..meta import D8, GridMeta
from ..plans.lineage import cut, settled
from . import graph, stencil, terrain


def d8(cells: DataFrame, meta: GridMeta, sink_mode: str = "outlet", keep: tuple[str, ...] = ()) -> DataFrame:
    """Steepest-descent code; ties go to the first of E SE S SW W NW N NE.

    Without a lower neighbour: 0 ('outlet'), or the lowest neighbour even uphill ('lowest').
    """
    near = stencil.neighbours(cells.select("r", "c", "z", *keep), nearest=False)
    names = [f"_d{code}" for code, _, _ in D8]
    near = near.withColumns({n: (F.col("z") - v) / F.lit(meta.step(dr, dc)) for n, (_, dr, dc), v in zip(names, D8, stencil.around(), strict=True)})
    near = near.withColumn("_best", F.greatest(*names))
    drops, best = [F.col(n) for n in names], F.col("_best")
    steep, low, lowest = F.lit(0), F.lit(0), F.least(*stencil.around())
    for (code, _, _), drop, v in reversed(list(zip(D8, drops, stencil.around(), strict=True))):
        steep, low = F.when(drop == best, code).otherwise(steep), F.when(v == lowest, code).otherwise(low)
    found = F.when(best > 0, steep).otherwise(low if sink_mode == "lowest" else F.lit(0))
    return near.select("r", "c", F.when(F.col("z").isNotNull(), F.coalesce(found, F.lit(0))).cast("int").alias("dir"), *keep)


def rho8(cells: DataFrame, meta: GridMeta, seed: int = 1) -> DataFrame:
    """D8 whose diagonal distances are 1 / (2 - u) shorter at random; u by a seeded md5."""
    near = stencil.neighbours(cells.select("r", "c", "z"), nearest=False)
    drops = {}
    for (code, dr, dc), v in zip(D8, stencil.around(), strict=True):
        u = F.conv(F.substring(F.md5(F.concat_ws(",", "r", "c", F.lit(code), F.lit(seed))), 1, 5), 16, 10).cast("double") / float(1 << 20)
        drops[f"_d{code}"] = (F.col("z") - v) / ((F.lit(2.0) - u) * meta.dx if dr and dc else F.lit(meta.step(dr, dc)))
    near = near.withColumns(drops).withColumn("_best", F.greatest(*drops))
    best, found = F.col("_best"), F.lit(0)
    for (code, _, _), drop in reversed(list(zip(D8, drops, strict=True))):
        found = F.when(F.col(drop) == best, code).otherwise(found)
    return near.select("r", "c", F.when(F.col("z").isNotNull(), F.when(best > 0, found).otherwise(0)).cast("int").alias("dir"))


#: Facets of the triangular scheme: cardinal and diagonal neighbour, base angle turns, sign.
FACETS = (("e", "ne", 0, 1), ("n", "ne", 1, -1), ("n", "nw", 1, 1), ("w", "nw", 2, -1), ("w", "sw", 2, 1), ("s", "sw", 3, -1), ("s", "se", 3, 1), ("e", "se", 4, -1))


def dinf(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Angle (radians from east, counter-clockwise) of the steepest of eight triangular
    facets; -1 where nothing descends. A facet with a NULL corner is left out."""
    near = stencil.neighbours(cells.select("r", "c", "z"), nearest=False)
    slopes, angles = {}, {}
    for k, (side, corner, turns, sign) in enumerate(FACETS):
        d1, d2 = (meta.dx, meta.dy) if side in "ew" else (meta.dy, meta.dx)
        s1, s2, wide = (F.col("z") - F.col(side)) / d1, (F.col(side) - F.col(corner)) / d2, atan2(d2, d1)
        r = F.atan2(s2, s1)
        s = F.when(r < 0, s1).when(r > wide, (F.col("z") - F.col(corner)) / meta.diagonal).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        slopes[f"_s{k}"] = s
        angles[f"_a{k}"] = (F.lit(turns * pi / 2) + sign * F.when(r < 0, 0.0).when(r > wide, wide).otherwise(r))
    near = near.withColumns({**slopes, **angles}).withColumn("_best", F.greatest(*slopes))
    best, angle = F.col("_best"), F.lit(-1.0)
    for s, a in reversed(list(zip(slopes, angles, strict=True))):
        angle = F.when(F.col(s) == best, F.col(a)).otherwise(angle)
    turned = F.when(angle >= 2 * pi, angle - 2 * pi).otherwise(angle)
    return near.select("r", "c", F.when(F.col("z").isNotNull(), F.when(best > 0, turned).otherwise(-1.0)).alias("angle"))


def force_edge(flow: DataFrame, meta: GridMeta) -> DataFrame:
    """Border cells flow off the grid; corners diagonally."""
    r, c, last_r, last_c = F.col("r"), F.col("c"), meta.rows - 1, meta.cols - 1
    form = F.when((r == 0) & (c == 0), 32).when((r == 0) & (c == last_c), 128).when((r == last_r) & (c == 0), 8).when((r == last_r) & (c == last_c), 2)
    return flow.select("r", "c", form.when(r == 0, 64).when(r == last_r, 4).when(c == 0, 16).when(c == last_c, 1).otherwise(F.col("dir")).cast("int").alias("dir"))


def _cells(flow: DataFrame, found: DataFrame, value, name: str) -> DataFrame:
    at = flow.select("r", "c", F.when(F.col("dir").isNotNull(), graph.node(F.col("r"), F.col("c"))).alias("node"))
    return at.join(found, "node", "left").select("r", "c", value.alias(name))


def accumulate(flow: DataFrame, meta: GridMeta, weights: DataFrame | None = None, cyclic: bool = False) -> DataFrame:
    """Cells (or weights w) that drain through each cell, itself included.

    cyclic: the routing may hold cycles; their cells pass nothing on.
    """
    flow = settled(flow)
    e = graph.edges(flow, meta)
    if cyclic:
        e = graph.without_cycles(e)
    s = e.select("node", F.col("parent").alias("ptr"), F.lit(0.0).alias("len"), F.lit(1.0).alias("val"))
    if weights is not None:
        w = weights.select(graph.node(F.col("r"), F.col("c")).alias("node"), F.col("w").alias("_w"))
        s = s.join(w, "node", "left").withColumn("val", F.coalesce("_w", F.lit(1.0))).drop("_w")
    done = graph.fold_up(s, F.sum, lambda a, b: a + b)
    return _cells(flow, done, F.col("val"), "acc")


def length_down(flow: DataFrame, meta: GridMeta) -> DataFrame:
    """Path length to the outlet."""
    flow = settled(flow)
    e = graph.edges(flow, meta)
    done = graph.fold_down(e.select("node", F.col("parent").alias("ptr"), F.col("step").alias("val")), lambda a, b: a + b)
    return _cells(flow, done, F.col("val"), "down")


def length_up(flow: DataFrame, meta: GridMeta) -> DataFrame:
    """Longest path to a ridge above."""
    flow = settled(flow)
    e = graph.edges(flow, meta)
    s = e.select("node", F.col("parent").alias("ptr"), F.col("step").alias("len"), F.lit(0.0).alias("val"))
    done = graph.fold_up(s, F.max, F.greatest, lambda v, n: v + n)
    return _cells(flow, done, F.col("val"), "up")


def nearest_below(e: DataFrame, marks: DataFrame) -> DataFrame:
    """For each node the nearest marked node at or below it: node, target, dist. marks: node."""
    m = marks.select("node").distinct().withColumn("_m", F.lit(1))
    s = e.join(m, "node", "left").select("node", F.when(F.col("_m").isNull(), F.col("parent")).alias("ptr"), F.struct(F.when(F.col("_m") == 1, F.col("node")).alias("t"), F.when(F.col("_m") == 1, 0.0).otherwise(F.col("step")).alias("d")).alias("val"))
    done = graph.fold_down(s, lambda a, b: F.struct(b["t"].alias("t"), (a["d"] + b["d"]).alias("d")))
    return done.select("node", F.col("val.t").alias("target"), F.col("val.d").alias("dist"))


def outlet_of(flow: DataFrame, meta: GridMeta) -> DataFrame:
    """node, val: the last node of each path."""
    flow = settled(flow)
    e = graph.edges(flow, meta)
    return graph.fold_down(e.select("node", F.col("parent").alias("ptr"), F.col("node").alias("val")), lambda a, b: b)


def basins(flow: DataFrame, meta: GridMeta, off_grid_is_outlet: bool = True) -> DataFrame:
    """Basin ids 1.. in row-major order of the outlets; 0 elsewhere."""
    flow = settled(flow)
    e = graph.edges(flow, meta)
    done = outlet_of(flow, meta)
    outlets = e.filter((F.col("dir") == 0) | (F.col("off") if off_grid_is_outlet else F.lit(False)))
    ids = graph.row_major_ids(outlets.select("r", "c")).select(graph.node(F.col("r"), F.col("c")).alias("val"), "id")
    return _cells(flow, done.join(ids, "val", "left").select("node", "id"), F.coalesce("id", F.lit(0)), "basin")


def watersheds(flow: DataFrame, meta: GridMeta, seeds: DataFrame) -> DataFrame:
    """Label of the nearest seed downstream, the cell itself first; 0 without one. seeds: r, c, seed."""
    flow = settled(flow)
    some = seeds.filter("seed > 0").select(graph.node(F.col("r"), F.col("c")).alias("target"), "seed")
    near = nearest_below(graph.edges(flow, meta), some.select(F.col("target").alias("node")))
    return _cells(flow, near.join(some, "target").select("node", "seed"), F.coalesce("seed", F.lit(0)).cast("long"), "watershed")


def watersheds_last_wins(flow: DataFrame, meta: GridMeta, points: DataFrame) -> DataFrame:
    """Largest index among all points downstream. points: r, c, k."""
    flow = settled(flow)
    marks = points.groupBy("r", "c").agg(F.max("k").alias("k")).select(graph.node(F.col("r"), F.col("c")).alias("node"), "k")
    s = graph.edges(flow, meta).join(marks, "node", "left").select("node", F.col("parent").alias("ptr"), F.coalesce("k", F.lit(0)).cast("long").alias("val"))
    return _cells(flow, graph.fold_down(s, F.greatest), F.coalesce("val", F.lit(0)).cast("long"), "watershed")


def above_stream(flow: DataFrame, meta: GridMeta, streams: DataFrame, cells: DataFrame) -> DataFrame:
    """dist and hand: path length and height to the first stream cell downstream."""
    flow = settled(flow)
    marks = streams.filter("stream > 0").select(graph.node(F.col("r"), F.col("c")).alias("node"))
    near = nearest_below(graph.edges(flow, meta), marks).filter("target is not null")
    z = cells.select(graph.node(F.col("r"), F.col("c")).alias("target"), F.col("z").alias("tz"))
    own = cells.select(graph.node(F.col("r"), F.col("c")).alias("node"), F.col("r"), F.col("c"), "z")
    return own.join(near.join(z, "target"), "node", "left").select("r", "c", "dist", (F.col("z") - F.col("tz")).alias("hand"))


def outlet_statistics(flow: DataFrame, meta: GridMeta, cells: DataFrame) -> DataFrame:
    """drop: height above the path's outlet; mean_slope: drop over the path length, 0 at outlets."""
    z = cells.select(graph.node(F.col("r"), F.col("c")).alias("val"), F.col("z").alias("oz"))
    flow = settled(flow)
    ends = outlet_of(flow, meta).join(z, "val").select("node", "oz")
    down = length_down(flow, meta).select(graph.node(F.col("r"), F.col("c")).alias("node"), "down")
    own = cells.select(graph.node(F.col("r"), F.col("c")).alias("node"), "r", "c", "z")
    drop = F.col("z") - F.col("oz")
    return own.join(ends, "node", "left").join(down, "node", "left").select("r", "c", drop.alias("drop"), F.when(F.col("down") > 0, drop / F.when(F.col("down") > 0, F.col("down"))).when(F.col("down").isNotNull(), 0.0).alias("mean_slope"))


def inflow_count(flow: DataFrame, meta: GridMeta) -> DataFrame:
    flow = settled(flow)
    e = graph.edges(flow, meta)
    n = e.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return flow.select("r", "c", graph.node(F.col("r"), F.col("c")).alias("node")).join(n, "node", "left").select("r", "c", F.coalesce("n", F.lit(0)).alias("inflows"))


def parallel_flow(flow: DataFrame) -> DataFrame:
    """1 where a neighbour flows in the same direction."""
    near = stencil.neighbours(flow.select("r", "c", "dir"), "dir", nearest=False)
    same = F.lit(False)
    for v in stencil.around():
        same = same | F.coalesce(v == F.col("dir"), F.lit(False))
    return near.select("r", "c", F.when((F.col("dir") > 0) & same, 1).otherwise(0).alias("parallel"))


def drop_slope(flow: DataFrame, meta: GridMeta, cells: DataFrame) -> DataFrame:
    """Fall to the cell below per length; NULL without one."""
    e = graph.edges(flow, meta).filter("parent is not null").select("r", "c", "parent", "step")
    z = cells.select(graph.node(F.col("r"), F.col("c")).alias("parent"), F.col("z").alias("pz"))
    down = e.join(z, "parent").select("r", "c", "pz", "step")
    return cells.join(down, ["r", "c"], "left").select("r", "c", ((F.col("z") - F.col("pz")) / F.col("step")).alias("fall"))


def _proportional(cells: DataFrame, meta: GridMeta, exponent: float) -> DataFrame:
    near = stencil.neighbours(cells.select("r", "c", "z"), nearest=False).filter("z is not null")
    shares = [F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.when(v < F.col("z"), F.pow((F.col("z") - v) / F.lit(meta.step(dr, dc)), F.lit(exponent))).alias("w")) for (_, dr, dc), v in zip(D8, stencil.around(), strict=True)]
    lower = near.select("r", "c", "z", F.filter(F.array(*shares), lambda s: s["w"].isNotNull()).alias("all"))
    out = lower.withColumn("total", F.aggregate("all", F.lit(0.0), lambda t, s: t + s["w"])).select("r", "c", "z", "total", F.explode("all").alias("s"))
    return out.select("r", "c", "z", (F.col("r") + F.col("s.dr")).alias("r2"), (F.col("c") + F.col("s.dc")).alias("c2"), (F.col("s.w") / F.col("total")).alias("share"))


def _spread(cells: DataFrame, shares: DataFrame, tile: int = 128) -> DataFrame:
    """Accumulation over shares (r, c, z, r2, c2, share) that always lead to a lower cell.

    A tile passes what it has down its own cells, highest first, and hands on what leaves it;
    the next round works on tiles that got something. Rounds are as many as a path crosses
    tiles, and a path sinks, so they end.
    """
    at = [F.floor(F.col(x) / tile).cast("int").alias(y) for x, y in (("r", "tr"), ("c", "tc"))]
    edges = cut(shares.select("r", "c", "z", "r2", "c2", "share", *at))
    moving = cells.filter("z is not null").select("r", "c", F.lit(1.0).alias("a"))

    def run(key: tuple[int, int], own: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
        top, left, wide = key[0] * tile - 1, key[1] * tile - 1, tile + 2
        mass = np.zeros(wide * wide)
        np.add.at(mass, (arrived["r"].to_numpy() - top) * wide + arrived["c"].to_numpy() - left, arrived["a"].to_numpy())
        order = np.lexsort((own["c2"], own["r2"], own["c"], own["r"], -own["z"]))
        one, two = (((own[r].to_numpy() - top) * wide + own[c].to_numpy() - left)[order].tolist() for r, c in (("r", "c"), ("r2", "c2")))
        held = mass.tolist()
        for i, j, s in zip(one, two, own["share"].to_numpy()[order].tolist(), strict=True):
            held[j] += held[i] * s
        mass = np.array(held)
        some = np.flatnonzero(mass)
        r, c = some // wide, some % wide
        return pd.DataFrame({"r": r + top, "c": c + left, "a": mass[some], "inside": (r > 0) & (c > 0) & (r <= tile) & (c <= tile)})

    done = []
    while not done or moving.limit(1).count():
        got = moving.select("r", "c", "a", *at)
        due = edges if not done else edges.join(got.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
        out = cut(due.groupBy("tr", "tc").cogroup(got.groupBy("tr", "tc")).applyInPandas(run, "r int, c int, a double, inside boolean"))
        done.append(out.filter("inside").select("r", "c", "a"))
        moving = cut(out.filter("not inside").groupBy("r", "c").agg(F.sum("a").alias("a")))
        if len(done) == 16:
            done = [cut(reduce(DataFrame.unionByName, done).groupBy("r", "c").agg(F.sum("a").alias("a")))]
    total = reduce(DataFrame.unionByName, done).groupBy("r", "c").agg(F.sum("a").alias("a"))
    return cells.select("r", "c", "z").join(total, ["r", "c"], "left").select("r", "c", F.when(F.col("z").isNotNull(), F.col("a")).alias("acc"))


def accumulate_fd8(cells: DataFrame, meta: GridMeta, exponent: float = 1.1) -> DataFrame:
    """Multiple-flow accumulation: shares by slope ^ exponent over all lower neighbours."""
    return _spread(cells, _proportional(cells, meta, exponent))


def accumulate_dinf(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Accumulation split between the two neighbours that enclose the facet angle."""
    a = cut(dinf(cells, meta)).filter("angle >= 0").withColumn("k", F.floor(F.col("angle") / (pi / 4)).cast("int")).withColumn("t", F.col("angle") / (pi / 4) - F.col("k"))
    ring = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
    at = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in ring])
    both = F.array(F.struct(at[F.col("k") % 8].alias("o"), (1.0 - F.col("t")).alias("share")), F.struct(at[(F.col("k") + 1) % 8].alias("o"), F.col("t").alias("share")))
    e = a.select("r", "c", F.explode(both).alias("s")).filter("s.share > 1e-12")
    lower = cells.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2")).filter("z2 is not null")
    e = e.withColumns({"r2": F.col("r") + F.col("s.o.dr"), "c2": F.col("c") + F.col("s.o.dc")}).join(lower, ["r2", "c2"]).join(cells.select("r", "c", "z"), ["r", "c"]).filter("z2 < z")
    shares = e.select("r", "c", "z", "r2", "c2", F.col("s.share").alias("share"))
    return _spread(cells, shares)


def watershed_of_cell(flow: DataFrame, meta: GridMeta, row: int, col: int) -> DataFrame:
    """1 for the cell and all cells that drain through it, else 0."""
    seed = flow.filter((F.col("r") == row) & (F.col("c") == col)).select("r", "c", F.lit(1).alias("seed"))
    return watersheds(flow, meta, seed).withColumn("watershed", F.col("watershed").cast("int"))


def route(cells: DataFrame, meta: GridMeta, method: str = "FD8") -> DataFrame:
    """Accumulation by multiple flow or D8, without filling first."""
    if method == "FD8":
        return accumulate_fd8(cells, meta)
    return accumulate(d8(cells, meta), meta)


def path_statistic(name: str, flow: DataFrame, meta: GridMeta, streams: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """r, c, value of one of twelve path statistics; an unknown name gives zeros.

    downslope_distance and hand need streams, hand and the elevation statistics cells.
    """
    needs = {"downslope_distance": ("streams",), "hand": ("streams", "cells"), "avg_flowpath_slope": ("cells",), "max_downslope_elev_change": ("cells",)}
    for what in needs.get(name, ()):
        if {"streams": streams, "cells": cells}[what] is None:
            raise ValueError(f"{name} needs {what}")
    flow = settled(flow)
    if name in ("downslope_distance", "hand"):
        near = above_stream(flow, meta, streams, cells if cells is not None else flow.select("r", "c", F.lit(0.0).alias("z")))
        found = near.select("r", "c", F.col("dist" if name == "downslope_distance" else "hand").alias("value"))
    elif name in ("max_upslope_length", "downslope_length"):
        found = (length_up if name == "max_upslope_length" else length_down)(flow, meta).toDF("r", "c", "value")
    elif name in ("flow_length_diff", "longest_flowpath"):
        up, down = length_up(flow, meta), length_down(flow, meta)
        value = F.col("down") - F.col("up") if name == "flow_length_diff" else F.col("down") + F.col("up")
        found = up.join(down, ["r", "c"]).select("r", "c", value.alias("value"))
    elif name == "num_inflowing":
        found = inflow_count(flow, meta).toDF("r", "c", "value")
    elif name == "num_upslope":
        found = accumulate(flow, meta).select("r", "c", (F.col("acc") - 1).alias("value"))
    elif name == "num_downslope":
        found = flow.select("r", "c", F.when(F.col("dir") > 0, 1).otherwise(0).alias("value"))
    elif name in ("avg_flowpath_slope", "max_downslope_elev_change"):
        found = outlet_statistics(flow, meta, cells).select("r", "c", F.col("mean_slope" if name == "avg_flowpath_slope" else "drop").alias("value"))
    else:
        found = flow.select("r", "c", F.lit(0.0).alias("value"))
    return found.select("r", "c", F.col("value").cast("double").alias("value"))


def indices(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """twi, spi, sti and valley index from slope and D8 accumulation of the same grid."""
    flow = settled(d8(cells, meta))
    both = cut(terrain.slope(cells, meta, "radians").join(accumulate(flow, meta), ["r", "c"]))
    top = both.agg(F.max(F.degrees("slope")).alias("_top"))
    s, a = F.col("slope"), (F.col("acc") + 1.0) * meta.dx
    rel = F.degrees(s) / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))
    return both.crossJoin(F.broadcast(top)).select(
        "r", "c", F.when(s.isNotNull(), F.log(a / F.tan(F.greatest(s, F.lit(0.001))))).alias("twi"), (a * F.tan(s)).alias("spi"),
        (F.pow(a / 22.13, F.lit(0.6)) * F.pow(F.sin(s) / 0.0896, F.lit(1.3))).alias("sti"), ((1.0 - rel) * F.log1p("acc")).alias("valley"),
    )


def snap_points(points: DataFrame, acc: DataFrame, meta: GridMeta, distance: float = 10.0) -> DataFrame:
    """Points moved to the cell of largest accumulation within a square; first row-major on
    ties. Points outside, or over NULL only, stay."""
    k = max(1, int(distance / meta.dx))
    p = points.withColumns({"_r": (-F.col("y") / meta.dy).cast("int"), "_c": (F.col("x") / meta.dx).cast("int")})
    inside = (F.col("_r") >= 0) & (F.col("_c") >= 0) & (F.col("_r") < meta.rows) & (F.col("_c") < meta.cols)
    # buckets of the search size: a point asks the buckets its square touches
    near = p.filter(inside).withColumn("_br", F.explode(F.sequence(F.floor((F.col("_r") - k) / k).cast("int"), F.floor((F.col("_r") + k) / k).cast("int")))).withColumn("_bc", F.explode(F.sequence(F.floor((F.col("_c") - k) / k).cast("int"), F.floor((F.col("_c") + k) / k).cast("int"))))
    grid = acc.filter("acc is not null").withColumns({"_br": F.floor(F.col("r") / k).cast("int"), "_bc": F.floor(F.col("c") / k).cast("int")})
    hit = near.join(grid, ["_br", "_bc"]).filter((F.abs(F.col("r") - F.col("_r")) <= k) & (F.abs(F.col("c") - F.col("_c")) <= k))
    best = hit.groupBy("pid").agg(F.min(F.struct((-F.col("acc")).alias("a"), "r", "c")).alias("b"))
    return points.join(best, "pid", "left").select("pid", F.coalesce((F.col("b.c") + 0.5) * meta.dx, F.col("x")).alias("x"), F.coalesce(-(F.col("b.r") + 0.5) * meta.dy, F.col("y")).alias("y"))
