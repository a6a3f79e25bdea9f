"""Uniform shuffle into exact-size shards by a hypergeometric communication matrix.

1. Equal rows are counted and numbered, so that each row has an identity of its own; rows
   fall into blocks by a seeded hash of it, and each block's rows are counted.
2. A blocks x shards matrix of counts is drawn: its rows sum to the block sizes, its
   columns to shard sizes at most one apart, and it has the multivariate
   hypergeometric law that a uniform random permutation gives.
3. Each block permutes its rows (order of a seeded hash) and deals consecutive runs to
   the shards by the matrix.
4. Each shard permutes what it got: a second seeded hash cuts the shard into ranges, so
   the slots are numbered range by range and no task holds a whole shard.

Main path: DataFrame functions only. Only the block counts come to the driver, and the matrix
goes back as a small table that each task gets whole. Both are bounded: there are so many
blocks that the matrix has MATRIX_CELLS cells at most, however many rows there are.

The result depends on the rows, the shard count and the seed only: not on their order, their
partitions or on tasks that run again, since every order is total.

Rules: nulls are values like others, in any column. Equal rows are interchangeable, and
any number of them is spread evenly. Extra columns pass through; they must be of types that
can be grouped, and `shard`, `slot` and names beginning with `_shuffle_` are refused. An empty
table gives no rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK, LEAST_BLOCKS, MATRIX_CELLS = 100_000, 256, 1 << 20


def _stirling_error(n: float) -> float:
    """log n! less Stirling's approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    s = 1 / (n * n)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss of digits where x is near mean."""
    d = x - mean
    if abs(d) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = d / (x + mean)
    total, term, j = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        following = total + term / (2 * j + 1)
        if following == total:
            return total
        total, j = following, j + 1


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability, by its saddle point."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    q = 1 - p
    core = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return core + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw of the number of good items, by the inverse of the law from its mode."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    p = draws / total
    peak = math.exp(_log_binomial(mode, good, p) + _log_binomial(draws - mode, bad, p) - _log_binomial(draws, total, p))
    left, p, q, i, j = rng.random() - peak, peak, peak, mode, mode
    while left > 0 and (i > low or j < high):
        if j < high:
            q *= (good - j) * (draws - j) / ((j + 1) * (bad - draws + j + 1))
            j += 1
            left -= q
            if left <= 0:
                return j
        if i > low:
            p *= i * (bad - draws + i) / ((good - i + 1) * (draws - i + 1))
            i -= 1
            left -= p
            if left <= 0:
                return i
    return mode


def communication_matrix(block_sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts dealt from each block to each shard; columns differ by one at most."""
    rng = random.Random(seed)
    total = sum(block_sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for size in block_sizes:
        row, need, open_ = [], size, sum(room)
        for s in range(shards):
            k = need if s == shards - 1 else _hypergeometric(rng, room[s], open_ - room[s], need)
            open_ -= room[s]
            row.append(k)
            need -= k
        room = [r - k for r, k in zip(room, row, strict=True)]
        out.append(row)
    return out


def shuffle_to_shards(rows: DataFrame, shards: int = 8, seed: int = 17, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The rows with columns shard (0..shards-1) and slot (0.. without gaps in each shard)."""
    own = rows.columns
    if refused := [c for c in own if c.lower() in ("shard", "slot") or c.lower().startswith("_shuffle_")] + [c for c in set(own) if own.count(c) > 1]:
        raise ValueError(f"columns with reserved or repeated names: {refused}")
    spark, names = rows.sparkSession, [F.col(f"`{c}`") for c in own]
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_shuffle_n"))
    single = counted.withColumn("_shuffle_copy", F.explode(F.sequence(F.lit(1), F.col("_shuffle_n")))).drop("_shuffle_n")

    def key(salt: int):
        return F.xxhash64(*names, *[F.isnull(c) for c in names], F.col("_shuffle_copy"), F.lit(seed + salt))

    order = [*names, F.col("_shuffle_copy")]  # decides between equal hashes
    total = rows.count()
    n = min(max(LEAST_BLOCKS, -(-total // rows_per_block)), max(1, MATRIX_CELLS // shards))
    block = F.pmod(key(0), F.lit(n)).cast("int")
    sizes = {r["_shuffle_block"]: r["n"] for r in single.select(block.alias("_shuffle_block")).groupBy("_shuffle_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in blocks], shards, seed)
    dealt_to = [(b, [sum(row[: s + 1]) for s in range(shards)]) for b, row in zip(blocks, matrix, strict=True)]
    ends = F.broadcast(_small_table(spark, dealt_to))
    local = Window.partitionBy("_shuffle_block").orderBy(key(1), *order)
    dealt = single.withColumn("_shuffle_block", block).withColumn("_shuffle_rank", F.row_number().over(local))
    dealt = dealt.join(ends, "_shuffle_block").withColumn("shard", F.size(F.filter("_shuffle_ends", lambda e: e < F.col("_shuffle_rank"))).cast("int"))
    ranges = max(32, n // shards)
    cut = F.floor((F.shiftrightunsigned(key(2), 11).cast("double") / F.lit(float(1 << 53))) * ranges).cast("int")
    dealt = dealt.drop("_shuffle_rank", "_shuffle_ends", "_shuffle_block").withColumn("_shuffle_order", F.shiftrightunsigned(key(2), 1)).withColumn("_shuffle_range", cut)
    count = dealt.groupBy("shard", "_shuffle_range").agg(F.count(F.lit(1)).alias("_shuffle_size"))
    before = Window.partitionBy("shard").orderBy("_shuffle_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = count.withColumn("_shuffle_start", F.coalesce(F.sum("_shuffle_size").over(before), F.lit(0))).drop("_shuffle_size")
    inner = Window.partitionBy("shard", "_shuffle_range").orderBy("_shuffle_order", *order)
    ranked = dealt.withColumn("_shuffle_k", F.row_number().over(inner))
    return ranked.join(starts, ["shard", "_shuffle_range"]).withColumn("slot", (F.col("_shuffle_start") + F.col("_shuffle_k") - 1).cast("long")).select(*names, "shard", "slot")


def _small_table(spark, dealt_to: list[tuple[int, list[int]]]) -> DataFrame:
    """_shuffle_block, _shuffle_ends of a matrix of MATRIX_CELLS cells at most."""
    text = "[" + ",".join(f'{{"_shuffle_block":{b},"_shuffle_ends":{ends}}}' for b, ends in dealt_to) + "]"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<_shuffle_block int, _shuffle_ends array<bigint>>>")).alias("_e")).select("_e.*")
