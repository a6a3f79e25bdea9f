"""Functional graphs (each node has at most one node below) by pointer doubling.

A node is (r << 32) | c. Rounds are logarithmic in the longest path; each round is one or
two equi-joins on node ids and ends in a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import D8, GridMeta
from ..plans.lineage import MAX_ROUNDS, cut


def node(r: Column, c: Column) -> Column:
    return F.shiftleft(r.cast("long"), 32) + c


def edges(flow: DataFrame, meta: GridMeta, code: str = "dir") -> DataFrame:
    """node, r, c, code, parent (NULL at an outlet or off the grid), step, off (leaves the grid)."""
    d = F.col(code)
    at = F.bit_count(d - 1)  # position of the code's bit; past the end for 0
    dr, dc, step = (F.get(F.array(*[F.lit(x) for x in row]), at) for row in zip(*[(i, j, meta.step(i, j)) for _, i, j in D8], strict=True))
    r, c = F.col("r") + dr, F.col("c") + dc
    inside = (r >= 0) & (c >= 0) & (r < meta.rows) & (c < meta.cols)
    return flow.filter(d.isNotNull()).select(node(F.col("r"), F.col("c")).alias("node"), "r", "c", d.alias(code), F.when(inside, node(r, c)).alias("parent"), F.when(inside, step).otherwise(F.lit(0.0)).alias("step"), F.coalesce(~inside, F.lit(False)).alias("off"))


def _rounds(state: DataFrame, advance: Callable[[DataFrame], DataFrame]) -> DataFrame:
    state = cut(state)
    for _ in range(MAX_ROUNDS):
        if state.filter("ptr is not null").limit(1).count() == 0:
            return state
        state = cut(advance(state))
    raise RuntimeError("the graph has a cycle; cut it first")


def fold_down(state: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """state (node, ptr, val): val folded along the path below, until no pointer is left."""

    def advance(s):
        below = s.select(F.col("node").alias("_n"), F.col("ptr").alias("_p"), F.col("val").alias("_v"))
        return s.join(below, s["ptr"] == below["_n"], "left").select("node", F.col("_p").alias("ptr"), F.when(F.col("_n").isNotNull(), combine(F.col("val"), F.col("_v"))).otherwise(F.col("val")).alias("val"))

    return _rounds(state, advance).drop("ptr")


def fold_up(state: DataFrame, aggregate: Callable[[Column], Column], combine: Callable[[Column, Column], Column], through: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """state (node, ptr, len, val): val folded over everything above a node.

    Each round adds to every node what its 2^k-th descendants hold; `through(val, len)` is
    what a value becomes on its way down the pointer (default: itself).
    """
    moved = (lambda v, n: v) if through is None else through

    def advance(s):
        arrived = s.filter("ptr is not null").groupBy(F.col("ptr").alias("_n")).agg(aggregate(moved(F.col("val"), F.col("len"))).alias("_a"))
        below = s.select(F.col("node").alias("_b"), F.col("ptr").alias("_p"), F.col("len").alias("_l"))
        df = s.join(arrived, s["node"] == arrived["_n"], "left").join(below, F.col("ptr") == F.col("_b"), "left")
        return df.select("node", F.col("_p").alias("ptr"), (F.col("len") + F.coalesce("_l", F.lit(0.0))).alias("len"), F.when(F.col("_n").isNotNull(), combine(F.col("val"), F.col("_a"))).otherwise(F.col("val")).alias("val"))

    return _rounds(state, advance).drop("ptr", "len")


def cycle_nodes(e: DataFrame) -> DataFrame:
    """Nodes on cycles: what is still pointed at after as many hops as there are nodes."""
    s, hops, total = cut(e.select("node", F.col("parent").alias("ptr"))), 1, e.count()
    while hops < total:
        below = s.select(F.col("node").alias("_n"), F.col("ptr").alias("_p"))
        s = cut(s.join(below, s["ptr"] == below["_n"], "left").select("node", F.col("_p").alias("ptr")))
        hops *= 2
    return s.filter("ptr is not null").select(F.col("ptr").alias("node")).distinct()


def without_cycles(e: DataFrame) -> DataFrame:
    """Edges with those that leave cycle nodes removed."""
    on = cycle_nodes(e).withColumn("_on", F.lit(1))
    return e.join(on, "node", "left").withColumn("parent", F.when(F.col("_on").isNull(), F.col("parent"))).drop("_on")


def label_components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of an undirected graph given by pairs (node, other)
    in both directions: rounds of the neighbours' minimum with a pointer shortcut."""
    pairs, label = cut(pairs.select("node", "other")), cut(nodes.select("node", F.col("node").alias("comp")))
    while True:  # labels only sink
        near = pairs.join(label.select(F.col("node").alias("other"), F.col("comp").alias("oc")), "other").groupBy("node").agg(F.min("oc").alias("oc"))
        low = label.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("oc", "comp")).alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        new = cut(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("comp"), (F.least("low", F.coalesce("lower", "low")) != F.col("comp")).alias("moved")))
        label = new.select("node", "comp")
        if new.filter("moved").limit(1).count() == 0:
            return label


def row_major_ids(cells: DataFrame) -> DataFrame:
    """r, c, id 1.. in row-major order: counts of rows first, then numbers inside rows."""
    per_row = cells.groupBy("r").agg(F.count(F.lit(1)).alias("_n"))
    first = per_row.select("r", F.coalesce(F.sum("_n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"))
    k = F.row_number().over(Window.partitionBy("r").orderBy("c"))
    return cells.select("r", "c", k.alias("_k")).join(first, "r").select("r", "c", (F.col("_f") + F.col("_k")).cast("int").alias("id"))
