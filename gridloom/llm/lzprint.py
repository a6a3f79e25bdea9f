"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78: each phrase is the shortest run of code
points not met as a phrase before). The set of phrases is hashed and its minimum-hash
signature is the fingerprint; the share of equal coordinates estimates the Jaccard
likeness of two phrase sets, which follows how well one text compresses given the other.

Rules: a null text is empty; an empty text has no phrase and the fingerprint of all
ones, like only to other empty texts. The last phrase, when met before, adds nothing.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textcore

COORDINATES = 64

_rng = np.random.default_rng(64)
_A = _rng.integers(1, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def units(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the units of a text, its single code points, and the code of each."""
    return np.arange(1, len(points) + 1, dtype=np.int64), points.astype(np.int64)


def parse(codes: list[int], trie: dict[int, int]) -> list[int]:
    """LZ78 parse of units; phrase j is the run of units between ends j-1 and j.

    The trie maps (node, unit) to the node below; nodes are numbered as the phrases are.
    """
    node, size, get, ends = 0, 0, trie.get, []
    add = ends.append
    for i, c in enumerate(codes, 1):
        key = node + c
        below = get(key)
        if below is None:
            size += 1
            trie[key] = size << 36
            add(i)
            node = 0
        else:
            node = below
    return ends


def parse_on(codes: list[int], trie: dict[int, int], k: int) -> list[int]:
    """The parse of further units after the first k phrases of a trie."""
    last, node, size, more, ends = k << 36, 0, len(trie), {}, []
    old, new, add = trie.get, more.get, ends.append
    for i, c in enumerate(codes, 1):
        key = node + c
        below = old(key)
        if below is None or below > last:
            below = new(key)
        if below is None:
            size += 1
            more[key] = size << 36
            add(i)
            node = 0
        else:
            node = below
    return ends


def _hashes(points: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit hashes of the consecutive phrases that end at b."""
    points = points.astype(np.uint64) + np.uint64(1)
    power, inverse = textcore._power_tables(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(points * power[: len(points)], out=total[1:])
    a = np.concatenate([[0], b[:-1]]).astype(np.int64)
    h = (total[b] - total[a]) * inverse[a]
    return (textcore.mix64(h + (b - a).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def minimum_hashes(groups: list[np.ndarray]) -> np.ndarray:
    """Minimum of each coordinate's hash over each group of values; all ones for an empty one."""
    out = np.full((len(groups), COORDINATES), 0xFFFFFFFF, dtype=np.uint32)
    i = 0
    while i < len(groups):
        j, held = i, 0
        while j < len(groups) and (j == i or held + len(groups[j]) <= 1 << 15):
            held += len(groups[j])
            j += 1
        live = [k for k in range(i, j) if len(groups[k])]
        if live:
            values = np.concatenate([groups[k] for k in live])
            at = np.concatenate([[0], np.cumsum([len(groups[k]) for k in live])[:-1]]).astype(np.int64)
            work = np.empty_like(values)
            for c in range(COORDINATES):
                np.multiply(values, _A[c], out=work)
                work += _B[c]
                out[live, c] = np.minimum.reduceat(work, at)
        i = j
    return out


def digest(sig: np.ndarray) -> str:
    """Upper 16 bits of each coordinate, as hex."""
    return (sig >> np.uint32(16)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(((a >> np.uint32(16)) == (b >> np.uint32(16))).mean())


class Parsed:
    """A text with its phrases (their ends in code points) and their hashes."""

    def __init__(self, text: str):
        self.text = text
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        unit_ends, codes = units(self.points)
        self.trie: dict[int, int] = {}
        found = parse(codes.tolist(), self.trie)
        self.ends = unit_ends[np.array(found, dtype=np.int64) - 1]
        self.hashes = _hashes(self.points, self.ends) if found else np.zeros(0, dtype=np.uint32)

    def edited(self, cut: int, tail: np.ndarray) -> tuple[str, int, np.ndarray]:
        """The text with everything from code point `cut` replaced by `tail`; how many of the
        own phrases it keeps (those that end before `cut`); the hashes of its further phrases."""
        k = int(np.searchsorted(self.ends, cut, side="left"))
        begin = int(self.ends[k - 1]) if k else 0
        rest = np.concatenate([self.points[begin:cut], tail])
        unit_ends, codes = units(rest)
        found = parse_on(codes.tolist(), self.trie, k)
        h = _hashes(rest, unit_ends[np.array(found, dtype=np.int64) - 1]) if found else np.zeros(0, dtype=np.uint32)
        return self.text[:cut] + tail.tobytes().decode("utf-32-le", "surrogatepass"), k, h


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts."""
    return [digest(s) for s in minimum_hashes([Parsed(t).hashes for t in texts])]


def ordered_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents dealt by ranges of the id, each range ended by the first row of the next.

    Columns _id, _text, _tail. Range bounds are ids (approximate percentiles), so every
    range but the first starts at a bound; the bound's row goes to the range before as
    well, as its tail, and the very first row is the tail of the last range. The text is
    shuffled once. Null ids sort first.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.select(key.alias("_k")).agg(F.min("_k").alias("low"), F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts")).first()
    low = found["low"]
    bounds = sorted({c for c in (found["cuts"] or []) if c > low}) if n > 1 and low is not None else []
    cuts = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_part", F.size(F.filter(cuts, lambda b: b <= F.col("_k"))))
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("tail"))
    before = F.struct((F.col("_part") - 1).alias("part"), F.lit(True).alias("tail"))
    around = F.struct(F.lit(len(bounds)).alias("part"), F.lit(True).alias("tail"))
    places = F.when(F.col("_k") == F.lit(low if low is not None else 0), F.array(own, around)).when(F.array_contains(cuts, F.col("_k")), F.array(own, before)).otherwise(F.array(own))
    rows = rows.withColumn("_place", F.explode(places)).select("_id", "_k", "_text", F.col("_place.part").alias("_part"), F.col("_place.tail").alias("_tail"))
    return rows.repartitionById(len(bounds) + 1, F.col("_part")).sortWithinPartitions("_tail", "_k", "_text").select("_id", "_text", "_tail")


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its text with the last quarter replaced by the
    start of the next document (ascending id, cyclic), and how like the fingerprints are."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(chain):
        """chain: consecutive (id, Parsed); a row for each but the last."""
        groups, texts = [], []
        for (_, mine), (_, following) in zip(chain, chain[1:], strict=False):
            n = len(mine.points)
            q = n // 4
            text, k, further = mine.edited(n - q, following.points[:q]) if q else (mine.text, len(mine.ends), mine.hashes[:0])
            groups += [mine.hashes[:k], mine.hashes[k:], further]
            texts.append(text)
        groups.append(chain[-1][1].hashes)
        low = minimum_hashes(groups)
        own = [np.minimum(low[3 * i], low[3 * i + 1]) for i in range(len(texts))] + [low[-1]]
        changed = [np.minimum(low[3 * i], low[3 * i + 2]) for i in range(len(texts))]
        return [
            (doc, len(mine.points), hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).hexdigest(), digest(own[i]), digest(changed[i]), likeness(own[i], changed[i]), likeness(own[i], own[i + 1]))
            for i, (doc, mine) in enumerate(chain[:-1])
        ]

    def run(batches):
        chain, held, tailed = [], 0, False
        for batch in batches:
            for doc, text, tail in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if tailed:
                    continue  # repeated rows of the bound
                chain.append((doc.as_py(), Parsed(text.as_py())))
                held, tailed = held + len(chain[-1][1].points), tail.as_py()
                if len(chain) > 1 and (tailed or held > 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows(chain), strict=True), types, strict=True)], names)
                    chain, held = chain[-1:], 0

    slim = ordered_ranges(docs, id_col, text_col)
    return store.map_arrow(slim, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
