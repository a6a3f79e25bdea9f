"""Stream networks: extraction, links, orders, cleaning, gaps, polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..meta import D8, GridMeta
from ..plans.lineage import cut, settled
from . import graph
from .vector import length_of, snap_lines


def extract(acc: DataFrame, threshold: float = 100.0, inclusive: bool = False) -> DataFrame:
    over = F.col("acc") >= threshold if inclusive else F.col("acc") > threshold
    return acc.select("r", "c", F.when(over, 1).otherwise(0).alias("stream"))


def stream_edges(flow: DataFrame, streams: DataFrame, meta: GridMeta) -> DataFrame:
    """Edges among stream cells with `down` (parent if it is a stream cell, too) and `inflow`."""
    on = streams.filter("stream > 0").select("r", "c")
    e = graph.edges(flow, meta).join(on, ["r", "c"])
    cells = e.select(F.col("node").alias("parent"), F.lit(1).alias("_s"))
    e = e.join(cells, "parent", "left").withColumn("down", F.when(F.col("_s") == 1, F.col("parent"))).drop("_s")
    n = e.filter("down is not null").groupBy(F.col("down").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("inflow"))
    return cut(e.join(n, "node", "left").withColumn("inflow", F.coalesce("inflow", F.lit(0))))


def _grid(flow: DataFrame, found: DataFrame, name: str, kind: str = "int") -> DataFrame:
    at = flow.select("r", "c", graph.node(F.col("r"), F.col("c")).alias("node"))
    return at.join(found, "node", "left").select("r", "c", F.coalesce(name, F.lit(0)).cast(kind).alias(name))


def _links(e: DataFrame) -> DataFrame:
    """node, link: heads (no or several stream inflows) numbered row by row, ids flow down
    while the next cell has one inflow."""
    heads = graph.row_major_ids(e.filter("inflow <> 1").select("r", "c")).select(graph.node(F.col("r"), F.col("c")).alias("node"), "id")
    above = e.filter("down is not null").select(F.col("down").alias("node"), F.col("node").alias("up"))
    chain = e.filter("inflow = 1").select("node").join(above, "node")
    s = e.select("node").join(heads, "node", "left").join(chain, "node", "left").select("node", F.col("up").alias("ptr"), F.coalesce("id", F.lit(0)).alias("val"))
    return graph.fold_down(s, F.greatest).select("node", F.col("val").alias("link"))


def link_ids(flow: DataFrame, streams: DataFrame, meta: GridMeta) -> DataFrame:
    flow = settled(flow)
    return _grid(flow, _links(stream_edges(flow, streams, meta)), "link")


def link_statistics(flow: DataFrame, streams: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Per link: link, cells, length (cells x dx), slope ((max z - min z) / length), path_length
    (steps inside the link)."""
    e = stream_edges(flow, streams, meta)
    link = cut(_links(e))
    below = link.select(F.col("node").alias("down"), F.col("link").alias("next"))
    z = cells.select(graph.node(F.col("r"), F.col("c")).alias("node"), "z")
    j = e.join(link, "node").join(below, "down", "left").join(z, "node").filter("link > 0")
    n = F.count(F.lit(1))
    return j.groupBy("link").agg(n.cast("int").alias("cells"), (n * meta.dx).alias("length"), ((F.max("z") - F.min("z")) / (n * meta.dx)).alias("slope"), F.sum(F.when(F.col("next") == F.col("link"), F.col("step")).otherwise(0.0)).alias("path_length"))


def strahler(flow: DataFrame, streams: DataFrame, meta: GridMeta) -> DataFrame:
    """Strahler order on the link graph: order k + 1 or more have the links at or below one
    with two inflows of order k or more. Each level at least halves the links that go on;
    rounds are the highest order times the logarithm of the depth."""
    flow = settled(flow)
    e = stream_edges(flow, streams, meta)
    link = cut(_links(e).filter("link > 0"))
    below = link.select(F.col("node").alias("down"), F.col("link").alias("next"))
    hops = e.join(link, "node").join(below, "down").filter("next <> link").groupBy("link").agg(F.min("next").alias("next"))
    live = cut(link.select("link").distinct().join(hops, "link", "left").select(F.col("link").cast("long").alias("node"), F.col("next").cast("long").alias("ptr")))
    levels = live.select(F.col("node").cast("int").alias("link"), F.lit(1).alias("strahler"))
    k = 1
    while True:  # each level has half the links of the one before at most
        k += 1
        joints = live.filter("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("node", F.lit(1).alias("_j"))
        state = cut(live.join(joints, "node", "left").select("node", "ptr", F.lit(0.0).alias("len"), F.coalesce("_j", F.lit(0)).alias("val")))
        if state.filter("val = 1").limit(1).count() == 0:
            break
        higher = graph.fold_up(state, F.max, F.greatest).filter("val = 1").select("node")
        live = cut(live.join(higher, "node", "left_semi"))
        levels = levels.unionByName(live.select(F.col("node").cast("int").alias("link"), F.lit(k).alias("strahler")))
    done = levels.groupBy("link").agg(F.max("strahler").alias("strahler"))
    return _grid(flow, link.join(done, "link").select("node", "strahler"), "strahler")


def shreve(flow: DataFrame, streams: DataFrame, meta: GridMeta) -> DataFrame:
    flow = settled(flow)
    e = stream_edges(flow, streams, meta)
    s = e.select("node", F.col("down").alias("ptr"), F.lit(0.0).alias("len"), F.when(F.col("inflow") == 0, 1).otherwise(0).cast("long").alias("val"))
    return _grid(flow, graph.fold_up(s, F.sum, lambda a, b: a + b).withColumnRenamed("val", "shreve"), "shreve", "long")


def _main_edges(e: DataFrame, acc: DataFrame) -> DataFrame:
    """Edges with main: is this the inflow of largest accumulation (first in D8 order seen from below)."""
    a = acc.select(graph.node(F.col("r"), F.col("c")).alias("node"), "acc")
    order = F.lit(0)
    for k, (code, _, _) in enumerate(D8):
        order = F.when(F.col("dir") == code, (k + 4) % 8).otherwise(order)
    first = Window.partitionBy("down").orderBy(F.desc("acc"), order)
    j = e.join(a, "node")
    return j.withColumn("main", F.when(F.col("down").isNotNull(), F.row_number().over(first) == 1).otherwise(False))


def hack(flow: DataFrame, streams: DataFrame, acc: DataFrame, meta: GridMeta) -> DataFrame:
    """1 on the main stem, one more at each turn off it."""
    flow = settled(flow)
    e = _main_edges(stream_edges(flow, streams, meta), acc)
    s = e.select("node", F.col("down").alias("ptr"), F.when(F.col("down").isNull(), 1).when(F.col("main"), 0).otherwise(1).alias("val"))
    return _grid(flow, graph.fold_down(s, lambda a, b: a + b).withColumnRenamed("val", "hack"), "hack")


def main_stem(flow: DataFrame, streams: DataFrame, acc: DataFrame, meta: GridMeta) -> DataFrame:
    return hack(flow, streams, acc, meta).select("r", "c", F.when(F.col("hack") == 1, 1).otherwise(0).alias("main"))


def horton(flow: DataFrame, streams: DataFrame, acc: DataFrame, meta: GridMeta) -> DataFrame:
    """Strahler order of the cell where the stem begins (outlet, or turn off a larger stem)."""
    flow = settled(flow)
    e = _main_edges(stream_edges(flow, streams, meta), acc)
    order = strahler(flow, streams, meta).select(graph.node(F.col("r"), F.col("c")).alias("node"), "strahler")
    s = e.join(order, "node").select("node", F.when(F.col("main"), F.col("down")).alias("ptr"), F.col("strahler").alias("val"))
    return _grid(flow, graph.fold_down(s, lambda a, b: b).withColumnRenamed("val", "horton"), "horton")


def remove_short(flow: DataFrame, streams: DataFrame, cells: DataFrame, meta: GridMeta, least: float) -> DataFrame:
    """Stream cells of links whose path length is `least` or more."""
    long = link_statistics(flow, streams, cells, meta).filter(F.col("path_length") >= least).select("link", F.lit(1).alias("stream"))
    return link_ids(flow, streams, meta).join(long, "link", "left").select("r", "c", F.coalesce("stream", F.lit(0)).alias("stream"))


def remove_isolated(flow: DataFrame, streams: DataFrame, acc: DataFrame, meta: GridMeta, least: float | None = None) -> DataFrame:
    """Stream cells whose path below reaches `least` accumulation or leaves the grid.

    Default: the 10th percentile of accumulation on streams.
    """
    on = streams.filter("stream > 0").join(acc, ["r", "c"])
    if least is None:
        least = on.agg(F.percentile("acc", 0.1)).first()[0] or 0.0
    a = acc.select(graph.node(F.col("r"), F.col("c")).alias("node"), "acc")
    s = graph.edges(flow, meta).join(a, "node").select("node", F.col("parent").alias("ptr"), F.when(F.col("off") | (F.col("acc") >= least), 1).otherwise(0).alias("val"))
    good = graph.fold_down(s, F.greatest).filter("val = 1").select("node")
    kept = on.select(graph.node(F.col("r"), F.col("c")).alias("node")).join(good, "node").withColumn("stream", F.lit(1))
    return _grid(flow, kept, "stream")


def main_network(flow: DataFrame, streams: DataFrame, meta: GridMeta) -> DataFrame:
    """Stream cells whose path ends at a sink or the edge (all, unless the routing has cycles)."""
    e = graph.edges(flow, meta)
    looped = graph.cycle_nodes(e)
    free = graph.without_cycles(e)
    ends = graph.fold_down(free.select("node", F.col("parent").alias("ptr"), F.col("node").alias("val")), lambda a, b: b)
    good = ends.join(looped.select(F.col("node").alias("val")), "val", "left_anti").select("node", F.lit(1).alias("_g"))
    at = streams.select("r", "c", graph.node(F.col("r"), F.col("c")).alias("node"), "stream").join(good, "node", "left")
    return at.select("r", "c", F.when((F.col("stream") > 0) & (F.col("_g") == 1), 1).otherwise(0).alias("stream"))


def gap_steps(threshold: float, meta: GridMeta, map_units: bool = False) -> int:
    """Steps of a gap limit in cells, or in map units (one more than the whole cells in it)."""
    return int(threshold / meta.dx) + 1 if map_units else int(threshold)


def slope_degrees(flow: DataFrame, streams: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Slope to the cell below in degrees on stream cells, 0 elsewhere and without one."""
    from .flow import drop_slope

    j = drop_slope(flow, meta, cells).join(streams.select("r", "c", "stream"), ["r", "c"])
    return j.select("r", "c", F.when(F.col("stream") > 0, F.coalesce(F.degrees(F.atan("fall")), F.lit(0.0))).otherwise(0.0).alias("slope"))


def raster_to_vector(flow: DataFrame, streams: DataFrame, meta: GridMeta, cells: DataFrame, acc: DataFrame | None = None, gap: float = 0.0, min_length: float = 0.0, remove_isolated_streams: bool = False, snap: float = 0.0, unit: str = "map", geographic: bool = False) -> DataFrame:
    """Polylines id, order, length, pts of a stream raster: gaps filled, short links and (with
    acc) isolated streams removed, endpoints snapped, lines below a tenth of min_length dropped.

    Units: pixels, map, or metres (111,320 to a degree on a geographic grid). snap 0 stands
    for one and a half cells; gap and min_length 0 leave their steps out.
    """
    scale = {"pixels": meta.dx, "map": 1.0, "metres": 1.0 / 111320.0 if geographic else 1.0}[unit]
    gap, min_length, snap = gap * scale, min_length * scale, snap * scale if snap > 0 else 1.5 * meta.dx
    flow = settled(flow)
    if gap > 0:
        streams = cut(join_gaps(flow, streams, meta, distance=gap))
    if min_length > 0:
        streams = cut(remove_short(flow, streams, cells, meta, min_length))
    if remove_isolated_streams and acc is not None:
        streams = cut(remove_isolated(flow, streams, acc, meta))
    lines = cut(segments(flow, streams, strahler(flow, streams, meta), meta))
    return snap_lines(lines, snap).withColumn("length", length_of("pts")).filter(F.col("length") >= 0.1 * min_length).select("id", "order", "length", "pts")


def join_gaps(flow: DataFrame, streams: DataFrame, meta: GridMeta, distance: float | None = None, hops: int | None = None) -> DataFrame:
    """Fills paths from a stream's end to the next stream cell downstream, if nearer than
    `distance`, or at most `hops` steps away. Tests the original mask only."""
    e = cut(graph.edges(flow, meta).join(streams.select("r", "c", "stream"), ["r", "c"]).select("node", "parent", "step", "stream"))
    target = e.select(F.col("node").alias("parent"), F.col("stream").alias("below"), F.col("parent").alias("next"), F.col("step").alias("nstep"))
    walk = e.filter("stream > 0").select("parent", F.col("step").alias("dist")).join(target, "parent").filter("below = 0")
    state = cut(walk.select(F.col("parent").alias("at"), "next", "nstep", "dist", F.array("parent").alias("path")))
    filled, k = None, 1
    if distance is None and hops is None:
        raise ValueError("a distance or a number of steps is needed")
    while True:  # each round adds a step to every path, so one of the limits ends it
        state = state.filter(F.col("dist") < distance) if distance is not None else state
        if (hops is not None and k >= hops) or state.limit(1).count() == 0:
            break
        on = state.filter("next is not null").select(F.col("next").alias("parent"), (F.col("dist") + F.col("nstep")).alias("dist"), "path").join(target, "parent")
        on = cut(on)
        met = on.filter("below > 0")
        met = met.filter(F.col("dist") < distance) if distance is not None else met
        part = met.select(F.explode("path").alias("node"))
        filled = part if filled is None else filled.unionByName(part)
        state = on.filter("below = 0").select(F.col("parent").alias("at"), "next", "nstep", "dist", F.concat("path", F.array("parent")).alias("path"))
        k += 1
    at = streams.select("r", "c", graph.node(F.col("r"), F.col("c")).alias("node"), "stream")
    if filled is None:
        return at.select("r", "c", F.when(F.col("stream") > 0, 1).otherwise(0).alias("stream"))
    return at.join(filled.distinct().withColumn("_f", F.lit(1)), "node", "left").select("r", "c", F.when((F.col("stream") > 0) | (F.col("_f") == 1), 1).otherwise(0).alias("stream"))


def points_of_interest(flow: DataFrame, streams: DataFrame, meta: GridMeta, kind: str) -> DataFrame:
    """headwaters (no inflow), junctions (several) or outlets (no stream below) as r, c."""
    e = stream_edges(flow, streams, meta)
    return e.filter({"headwaters": "inflow = 0", "junctions": "inflow > 1", "outlets": "down is null"}[kind]).select("r", "c")


def segments(flow: DataFrame, streams: DataFrame, orders: DataFrame, meta: GridMeta) -> DataFrame:
    """Polylines id, order, length, pts: one a link, from its head down, through the first
    cell of the next link; at least two points."""
    e = stream_edges(flow, streams, meta)
    link = _links(e).filter("link > 0")
    up = e.join(link, "node")
    before = up.filter("down is not null").select(F.col("down").alias("node"), "link", F.col("node").alias("ptr"))
    place = up.select("node", "link").join(before, ["node", "link"], "left").select("node", "ptr", F.when(F.col("ptr").isNotNull(), 1).otherwise(0).alias("val"))
    chain = graph.fold_down(place, lambda a, b: a + b)
    o = orders.select(graph.node(F.col("r"), F.col("c")).alias("node"), orders.columns[-1])
    rows = up.join(chain, "node").join(o, "node")
    own = rows.select("link", "val", "r", "c", F.col(orders.columns[-1]).alias("order"))
    tail = rows.filter("down is not null").select("link", (F.col("val") + 1).alias("val"), F.col("down")).join(link.select(F.col("node").alias("down"), F.col("link").alias("next")), "down").filter("next <> link")
    tail = tail.select("link", "val", F.shiftright("down", 32).cast("int").alias("r"), F.expr("cast(down & 4294967295 as int)").alias("c"), F.lit(None).cast("int").alias("order"))
    pt = F.struct("val", (F.col("c") + F.lit(0.5)).alias("x"), (-(F.col("r") + F.lit(0.5))).alias("y"))
    line = own.unionByName(tail).groupBy("link").agg(F.max("order").alias("order"), F.transform(F.sort_array(F.collect_list(pt)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    return line.filter(F.size("pts") >= 2).select(F.col("link").alias("id"), "order", length_of("pts").alias("length"), "pts")
