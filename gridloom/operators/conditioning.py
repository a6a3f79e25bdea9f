"""Depression filling, single-cell pits, breaching, stream burning."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import GridMeta
from ..plans.lineage import cut
from . import stencil, tiles

TILE = 256


def _filled(v: float, own: float, level: float, step: float) -> float:
    """Level that reaches a neighbour of elevation v: its own if that is not lower, else the
    level plus step."""
    return v if v >= level else level + step


def _on_flat(v: float, own: float, level: float, step: float) -> float:
    """Steps that reach a neighbour of elevation v from a cell of elevation `own`."""
    return level + step if v == own else math.inf


def _relax(z: np.ndarray, w: np.ndarray, fresh: np.ndarray, step: float, rule: Callable[..., float]) -> np.ndarray:
    """Least values of a tile given values on entry, smallest first; rule says what a value
    becomes at a neighbour, never less than it was. Work starts from the fresh values; the
    others have had their effect."""
    rows, cols = z.shape
    heap = [(w[r, c], r, c) for r, c in zip(*(x.tolist() for x in np.nonzero(np.isfinite(w) & fresh)), strict=True)]
    heapq.heapify(heap)
    z, w = z.tolist(), w.tolist()  # single cells of lists are read faster
    while heap:
        level, r, c = heapq.heappop(heap)
        if level > w[r][c]:
            continue
        own = z[r][c]
        for i in range(max(0, r - 1), min(rows, r + 2)):
            zi, wi = z[i], w[i]
            for j in range(max(0, c - 1), min(cols, c + 2)):
                v = zi[j]
                if v != v:
                    continue
                arrived = rule(v, own, level, step)
                if arrived < wi[j]:
                    wi[j] = arrived
                    heapq.heappush(heap, (arrived, i, j))
    return np.array(w)


def _least_values(start: DataFrame, meta: GridMeta, step: float, rule: Callable[..., float], tile: int) -> DataFrame:
    """r, c, z, w: the least fixpoint of values w (NULL: none yet) spread by a rule.

    Tiles relax on their own and exchange values over a halo of one cell until none changes;
    after the first round only tiles into whose halo a lower value has come work again.
    """
    state = cut(start.select("r", "c", "z", "w", F.lit(True).alias("changed")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own"]]
        z, r0, c0 = tiles.dense(pdf, "z")
        w, _, _ = tiles.dense(pdf, "w")
        before = np.where(np.isnan(w), np.inf, w)
        fresh = np.zeros(z.shape, dtype=bool)
        fresh[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = pdf["changed"].to_numpy(dtype=bool)
        after = _relax(z, before, fresh, step, rule)
        at = (own["r"].to_numpy() - r0, own["c"].to_numpy() - c0)
        now, was = after[at], before[at]
        null = lambda v: pd.arrays.FloatingArray(np.where(np.isfinite(v), v, 0.0), ~np.isfinite(v))
        return pd.DataFrame({"r": own["r"].to_numpy(), "c": own["c"].to_numpy(), "z": null(own["z"].to_numpy(dtype=float, na_value=np.nan)), "w": null(now), "changed": now != was})

    schema, first = "r int, c int, z double, w double, changed boolean", True
    while True:  # values only sink and have a least one, so this ends
        spread = tiles.with_halo(state, tile, 1, meta)
        if first:
            state = cut(spread.groupBy("tr", "tc").applyInPandas(run, schema))
        else:
            due = spread.filter("changed and not own").select("tr", "tc").distinct()
            work = spread.join(due, ["tr", "tc"], "left_semi").groupBy("tr", "tc").applyInPandas(run, schema)
            at = [F.floor(F.col(x) / tile).cast("int") for x in ("r", "c")]
            rest = state.withColumns({"tr": at[0], "tc": at[1]}).join(due, ["tr", "tc"], "left_anti").select("r", "c", "z", "w", F.lit(False).alias("changed"))
            state = cut(work.unionByName(rest))
        first = False
        if state.filter("changed").limit(1).count() == 0:
            return state.select("r", "c", "z", "w")


def fill(cells: DataFrame, meta: GridMeta, eps: float = 1e-3, tile: int = TILE) -> DataFrame:
    """Elevation raised so that every cell drains to the grid's border.

    The level is the least fixpoint over paths from border cells, so it does not depend on
    the order of work. Cells without a path to the border stay as they are.
    """
    border = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == meta.rows - 1) | (F.col("c") == meta.cols - 1)
    start = cells.select("r", "c", "z", F.when(border & F.col("z").isNotNull(), F.col("z")).alias("w"))
    return _least_values(start, meta, eps, _filled, tile).select("r", "c", F.coalesce("w", "z").alias("filled"))


def sink_depth(cells: DataFrame, meta: GridMeta, eps: float = 1e-3) -> DataFrame:
    """depth = filled - z, and sink = 1 where it is positive."""
    d = F.col("filled") - F.col("z")
    return cells.select("r", "c", "z").join(fill(cells, meta, eps), ["r", "c"]).select("r", "c", d.alias("depth"), F.when(d > 0, 1).otherwise(0).alias("sink"))


def fill_pits(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Cells below all valid neighbours rise to the lowest of them."""
    near = stencil.neighbours(cells.select("r", "c", "z"), nearest=False)
    low = F.least(*stencil.around())
    return near.select("r", "c", F.when(F.col("z") < low, low).otherwise(F.col("z")).alias("z"))


def breach_pits(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """The lowest neighbour (first in D8 order) of each pit sinks to the pit's level."""
    from ..meta import D8

    near = stencil.neighbours(cells.select("r", "c", "z"), nearest=False)
    low, at = F.least(*stencil.around()), F.lit(None).cast("int")
    for (code, _, _), v in reversed(list(zip(D8, stencil.around(), strict=True))):
        at = F.when(v == low, code).otherwise(at)
    pits = near.filter(F.col("z") < low).select("r", "c", "z", at.alias("code"))
    dr, dc = F.lit(0), F.lit(0)
    for code, i, j in D8:
        dr, dc = F.when(F.col("code") == code, i).otherwise(dr), F.when(F.col("code") == code, j).otherwise(dc)
    cuts = pits.select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col("z").alias("to")).groupBy("r", "c").agg(F.min("to").alias("to"))
    return cells.join(cuts, ["r", "c"], "left").select("r", "c", F.least("z", F.coalesce("to", "z")).alias("z"))


def components(mask: DataFrame, meta: GridMeta) -> DataFrame:
    """4-connected components of the cells of a mask: r, c, comp (smallest node id)."""
    from . import graph

    cells = mask.select(graph.node(F.col("r"), F.col("c")).alias("node"))
    sides = F.array(*[F.lit(x) for x in (1, -1, 1 << 32, -(1 << 32))])
    pairs = cells.select("node", F.explode(sides).alias("d")).select("node", (F.col("node") + F.col("d")).alias("other")).join(cells.select(F.col("node").alias("other")), "other")
    label = graph.label_components(pairs, cells)
    return label.select(F.shiftright("node", 32).cast("int").alias("r"), F.expr("cast(node & 4294967295 as int)").alias("c"), "comp")


def line_cells(r0: int, c0: int, r1: int, c1: int) -> list[tuple[int, int]]:
    """Integer line between two cells, both included."""
    n = max(abs(r1 - r0), abs(c1 - c0))
    out, error, r, c = [], 0, r0, c0
    dr, dc, sr, sc = abs(r1 - r0), abs(c1 - c0), 1 if r1 > r0 else -1, 1 if c1 > c0 else -1
    error = dc - dr
    for _ in range(n + 1):
        out.append((r, c))
        twice = 2 * error
        if twice > -dr:
            error -= dr
            c += sc
        if twice < dc:
            error += dc
            r += sr
    return out


def breach(cells: DataFrame, meta: GridMeta, depth: float = 1e-3, max_depth: float | None = None, max_length: float | None = None) -> DataFrame:
    """Depressions opened along a line from their highest cell to their outlet: each line cell
    above its lowest neighbour sinks to that neighbour's level less `depth`. Components work
    alone on their own cells and ring; overlapping lines keep the lower value.

    A depression whose line is longer than max_length, or would cut a cell by more than
    max_depth, stays as it is (no limit by default)."""
    deep = cells.select("r", "c", "z").join(fill(cells, meta, 0.0), ["r", "c"]).filter(F.col("filled") - F.col("z") > 0.001).select("r", "c", "z")
    comp = cut(components(deep, meta))
    ring = tiles_ring(comp, cells)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = {(r, c): v for r, c, v in zip(pdf["r"], pdf["c"], pdf["z"], strict=True)}
        inside = {(r, c) for r, c, own in zip(pdf["r"], pdf["c"], pdf["inside"], strict=True) if own}
        best = None
        for r, c in sorted(inside):
            outer = [z[n] for n in _around(r, c) if n in z and n not in inside and z[n] == z[n]]
            if outer and (best is None or min(outer) < best[0]):
                best = (min(outer), r, c)
        out = {}
        if best:
            top, was = max(sorted(inside), key=lambda p: z[p]), dict(z)
            line = line_cells(*top, best[1], best[2])
            for r, c in line:
                near = [z[n] for n in _around(r, c) if n in z and z[n] == z[n]]
                if r > 0 and c > 0 and (r, c) in z and z[r, c] == z[r, c] and near and z[r, c] > min(near) - depth:
                    z[r, c] = out[r, c] = min(near) - depth
            length = sum(meta.step(b[0] - a[0], b[1] - a[1]) for a, b in itertools.pairwise(line))
            if (max_length is not None and length > max_length) or (max_depth is not None and any(was[p] - v > max_depth for p, v in out.items())):
                out = {}
        return pd.DataFrame([(r, c, v) for (r, c), v in out.items()], columns=["r", "c", "to"])

    cuts = ring.groupBy("comp").applyInPandas(run, "r int, c int, to double").groupBy("r", "c").agg(F.min("to").alias("to"))
    return cells.join(cuts, ["r", "c"], "left").select("r", "c", F.least("z", F.coalesce("to", "z")).alias("z"))


def _around(r: int, c: int) -> list[tuple[int, int]]:
    return [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def tiles_ring(comp: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of each component and of the ring around it: comp, r, c, z, inside."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = comp.select("comp", F.explode(steps).alias("s"), "r", "c").select("comp", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
    own = comp.select("comp", "r", "c", F.lit(True).alias("inside"))
    return near.distinct().join(cells.select("r", "c", "z"), ["r", "c"]).join(own, ["comp", "r", "c"], "left").select("comp", "r", "c", "z", F.coalesce("inside", F.lit(False)).alias("inside"))


def resolve_flats(cells: DataFrame, meta: GridMeta, eps: float = 1e-6, tile: int = TILE) -> DataFrame:
    """Flat cells rise by eps per step from the nearest cell of equal level that drains."""
    near = stencil.neighbours(cells.select("r", "c", "z"), nearest=False)
    low = F.least(*stencil.around())
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == meta.rows - 1) | (F.col("c") == meta.cols - 1)
    start = near.select("r", "c", "z", F.when((low < F.col("z")) | (edge & F.col("z").isNotNull()), 0.0).alias("w"))
    return _least_values(start, meta, 1.0, _on_flat, tile).select("r", "c", (F.col("z") + F.coalesce("w", F.lit(0.0)) * eps).alias("z"))


def burn(cells: DataFrame, streams: DataFrame, decrement: float = 10.0) -> DataFrame:
    j = cells.select("r", "c", "z").join(streams.select("r", "c", "stream"), ["r", "c"])
    return j.select("r", "c", F.when(F.col("stream") > 0, F.col("z") - decrement).otherwise(F.col("z")).alias("z"))
