"""Ray marches: viewshed over sectors around the observer; openness and wind exposure over tiles
with a halo as wide as the rays are long."""

from __future__ import annotations

from math import cos, pi, radians, sin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import GridMeta
from . import tiles


#: Targets of one sector, about; samples worked on at once; steps that share one bound.
SECTOR, BLOCK, STRIDE = 1 << 19, 1 << 21, 64


class _Sector:
    """Elevations of a sector, row after row, and the highest of each ring of STRIDE cells."""

    def __init__(self, r: np.ndarray, c: np.ndarray, z: np.ndarray, row: int, col: int):
        self.top = int(r.min())
        at, size = r - self.top, int(r.max()) - self.top + 1
        self.low, self.high = np.full(size, np.iinfo(np.int64).max), np.full(size, -1, dtype=np.int64)
        np.minimum.at(self.low, at, c)
        np.maximum.at(self.high, at, c)
        self.start = np.concatenate([[0], np.cumsum(np.maximum(self.high - self.low + 1, 0))[:-1]])
        self.z = np.full(int(np.maximum(self.high - self.low + 1, 0).sum()), np.nan)
        self.z[self.start[at] + c - self.low[at]] = z
        ring = (np.hypot(r - row, c - col) / STRIDE).astype(np.int64)
        self.ceiling = np.full(int(ring.max()) + 3, -np.inf)
        np.fmax.at(self.ceiling, ring, z)

    def at(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """NaN where the grid has no cell."""
        k = np.clip(r - self.top, 0, len(self.low) - 1)
        inside = (r - self.top == k) & (c >= self.low[k]) & (c <= self.high[k])
        return np.where(inside, self.z[np.where(inside, self.start[k] + c - self.low[k], 0)], np.nan)

    def highest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """At least as high as every cell between the distances; they span three rings at most."""
        a, b = (np.clip((d / STRIDE).astype(np.int64), 0, len(self.ceiling) - 1) for d in (first, last))
        return np.maximum(np.maximum(self.ceiling[a], self.ceiling[b]), self.ceiling[np.minimum(a + 1, b)])


def _hidden(land: _Sector, row: int, col: int, dr: np.ndarray, dc: np.ndarray, z: np.ndarray, eye: float, target_height: float) -> np.ndarray:
    """True for each target of which a sample lies above the line of sight.

    Steps go outward, STRIDE at a time, for the targets that are not hidden yet. Where the line
    stays above all that the sector has at that distance, the steps are not looked up: the line
    is monotone, so its lower end decides.
    """
    dist = np.sqrt(dr * dr + dc * dc)
    steps = np.floor(dist)
    hidden = np.zeros(len(z), dtype=bool)
    live, i0 = np.flatnonzero((steps > 1) & ~np.isnan(z)), 1.0
    line = lambda k, i: eye + i * (z[k] + target_height - eye) / dist[k]
    while len(live):
        i1 = np.minimum(i0 + STRIDE, steps[live]) - 1
        scale = dist[live] / steps[live]
        look = live[land.highest(np.maximum(i0 * scale - 1, 0), i1 * scale + 1) > np.minimum(line(live, i0), line(live, i1))]
        width = 4 if i0 == 1 else 16  # most are hidden by what is near
        for i in np.arange(i0, i0 + STRIDE, width):
            look = look[~hidden[look] & (steps[look] > i)]
            for part in np.array_split(look, len(look) * width // BLOCK + 1):
                k, step = part[:, None], np.arange(i, i + width)[None, :]
                sr = np.rint(row + step * dr[k] / steps[k]).astype(np.int64)
                sc = np.rint(col + step * dc[k] / steps[k]).astype(np.int64)
                hidden[part] = ((land.at(sr, sc) > line(k, step)) & (step < steps[k])).any(axis=1)
        i0 += STRIDE
        live = live[~hidden[live] & (steps[live] > i0)]
    return hidden


def viewshed(cells: DataFrame, row: int, col: int, observer_height: float = 1.8, target_height: float = 0.0) -> DataFrame:
    """1 where the line of sight from the observer's cell is free; NoData is 0.

    Each target samples its line at whole steps (rounded half to even). The observer's
    elevation is one looked-up value. Targets are dealt by their direction: all samples of a
    sector lie in it or less than a cell beside it, so the grid is shuffled once.
    """
    seat = cells.filter((F.col("r") == row) & (F.col("c") == col)).select("z").first()
    if seat is None or seat["z"] is None:
        return cells.select("r", "c", F.lit(0).alias("seen"))
    eye = float(seat["z"]) + observer_height
    dr, dc = F.col("r").cast("double") - row, F.col("c").cast("double") - col
    count = -(-cells.count() // SECTOR)
    bounds = np.unique(cells.select(F.atan2(dr, dc).alias("a")).approxQuantile("a", [k / count for k in range(1, count)], 0.1 / count)) if count > 1 else np.empty(0)

    def dealt(batches):
        for batch in batches:
            r, c = (batch.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
            y, x = r.astype(float) - row, c.astype(float) - col
            angle, far = np.arctan2(y, x), np.hypot(y, x)
            own = np.searchsorted(bounds, angle, side="right")
            # a sample's cell has its centre 0.71 from the ray at most
            beside = np.where(far < 1, np.pi, np.arcsin(np.minimum(0.75 / np.maximum(far, 1), 1)))
            for k in range(len(bounds) + 1):
                a, b = (bounds[k - 1] if k else -np.pi), (bounds[k] if k < len(bounds) else np.pi)
                read = own == k
                for turn in (-2 * np.pi, 0, 2 * np.pi):
                    read |= (angle + turn + beside >= a) & (angle + turn - beside <= b)
                if read.any():
                    at = pa.array(np.flatnonzero(read))
                    mine = pa.array(own[read] == k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), *(batch.column(n).take(at) for n in ("r", "c", "z")), mine], ["sector", "r", "c", "z", "own"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf[n].to_numpy(dtype=np.int64) for n in ("r", "c"))
        z, own = pdf["z"].to_numpy(dtype=float, na_value=np.nan), pdf["own"].to_numpy(dtype=bool)
        land = _Sector(r, c, z, row, col)
        hidden = _hidden(land, row, col, r[own].astype(float) - row, c[own].astype(float) - col, z[own], eye, target_height)
        return pd.DataFrame({"r": r[own], "c": c[own], "seen": (~np.isnan(z[own]) & ~hidden).astype(np.int32)})

    spread = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z")).mapInArrow(dealt, "sector int, r int, c int, z double, own boolean")
    return spread.groupBy("sector").applyInPandas(run, "r int, c int, seen int")


def _steepest(a: np.ndarray, halo: int, ray: list[tuple[int, int, int]], size: float, sign: float = 1.0) -> np.ndarray:
    """Largest rise per length over the samples (step, row shift, column shift) of a ray; -inf
    where no sample is valid."""
    z = tiles.shifted(a, halo, 0, 0)
    best = np.full(z.shape, -np.inf)
    for i, dr, dc in ray:
        best = np.fmax(best, sign * (tiles.shifted(a, halo, dr, dc) - z) / (i * size))
    return best


def openness(cells: DataFrame, meta: GridMeta, radius: int = 10, negative: bool = False) -> DataFrame:
    """Mean over eight azimuths of 90 degrees less the steepest sight angle, in radians."""
    rays = [[(i, round(-i * cos(k * pi / 4)), round(i * sin(k * pi / 4))) for i in range(1, radius + 1)] for k in range(8)]
    sign = -1.0 if negative else 1.0

    def run(a: np.ndarray) -> np.ndarray:
        z = tiles.shifted(a, radius, 0, 0)
        total = sum(90.0 - np.degrees(np.arctan(_steepest(a, radius, ray, meta.dx, sign))) for ray in rays)
        return np.where(np.isnan(z), np.nan, np.radians(total / 8.0))

    return tiles.focal(cells, meta, run, radius, "openness")


def wind_exposure(cells: DataFrame, meta: GridMeta, azimuth: float = 315.0, max_dist: float = 100.0) -> DataFrame:
    """Largest upwind slope within max_dist; 0 without a sample."""
    t, reach = radians(azimuth), int(max_dist / meta.dx)
    ray = [(i, round(-i * cos(t)), round(i * sin(t))) for i in range(1, reach + 1)]

    def run(a: np.ndarray) -> np.ndarray:
        best = _steepest(a, reach, ray, meta.dx)
        return np.where(np.isnan(tiles.shifted(a, reach, 0, 0)), np.nan, np.where(np.isinf(best), 0.0, best))

    return tiles.focal(cells, meta, run, reach, "sx", tile=max(128, 2 * reach))
