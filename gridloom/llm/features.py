"""Hashed word n-gram features and bounded training samples for the text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, textcore


_KIND = np.zeros(256, dtype=np.uint64)  # 0 symbol, 1 small letter or non-ASCII, 2 capital, 3 digit, 4 stop, 5 comma
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[ord(".")] = 4
_KIND[ord(",")] = 5


def word_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A small code of how each word is written, and whether it repeats the word before."""
    kind = _KIND[data]
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    symbols = np.concatenate([[0], np.cumsum(kind == 0)])
    size = np.digitize(ends - starts, (2, 4, 7, 10, 15)).astype(np.uint64)
    code = kind[starts] * np.uint64(6) + kind[ends - 1]
    code = code * np.uint64(6) + size
    code = code * np.uint64(3) + np.minimum(capitals[ends] - capitals[starts], 2).astype(np.uint64)
    code = code * np.uint64(3) + np.minimum(symbols[ends] - symbols[starts], 2).astype(np.uint64)
    again = np.zeros(len(starts), dtype=np.uint64)
    again[1:] = hashes[1:] == hashes[:-1]
    return textcore.mix64(code * np.uint64(2) + again + np.uint64(1 << 40))


def hashed_rows(column: pa.Array, orders: tuple[int, ...], bits: int, shapes: tuple[int, ...] = (), prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges [a, b) of a text column: distinct n-gram buckets, their counts, row bounds.

    Every row also has bucket 0 as a bias, so an empty or null text has a score. With
    `shapes`, n-grams of word shapes fill the upper half of the buckets. With `prefixes`,
    words lose their outer punctuation and longer words also count by their first bytes.
    """
    data, offsets = textcore.flat(column)
    mask, half = np.uint64((1 << bits) - 1), np.uint64(1 << (bits - 1))
    for a, b in textcore.blocks(offsets):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, bounds = textcore.words(part, local)
        if prefixes:
            starts, ends = textcore.stripped(part, starts, ends)
        h = textcore.segment_hashes(part, starts, ends, lower=True)
        grams = [textcore.ngrams(h, bounds, n) for n in orders]
        if shapes:
            grams = [((g & mask) & ~half, gb) for g, gb in grams]
            s = word_shapes(part, starts, ends, h)
            grams += [(g | half, gb) for g, gb in (textcore.ngrams(s, bounds, n) for n in shapes)]
        for n in prefixes:
            long = ends - starts > n
            heads = textcore.segment_hashes(part, starts[long], starts[long] + n, lower=True)
            grams.append((textcore.mix64(heads + np.uint64(n)), np.concatenate([[0], np.cumsum(long)])[bounds]))
        rows = [np.repeat(np.arange(b - a), np.diff(gb)) for _, gb in grams]
        bias = np.arange(b - a)
        row = np.concatenate([bias, *rows]).astype(np.uint64)
        bucket = np.concatenate([np.zeros(b - a, dtype=np.uint64), *[(g & mask) | np.uint64(1) for g, _ in grams]])
        key = np.sort((row << np.uint64(bits)) | bucket)
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(fresh)
        counts = np.diff(np.append(at, len(key)))
        key = key[at]
        yield a, b, (key & mask).astype(np.int64), counts, np.searchsorted(key >> np.uint64(bits), np.arange(b - a + 1, dtype=np.uint64)).astype(np.int64)


def score_texts(docs: DataFrame, id_col: str, text_col: str, orders: tuple[int, ...], bits: int, value: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], weights: np.ndarray, keep: tuple[str, ...] = (), shapes: tuple[int, ...] = (), prefixes: tuple[int, ...] = ()) -> DataFrame:
    """One row per document: the id, `keep` columns, score = sigmoid(sparse dot product)."""
    weights = weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits floats, whatever the corpus

    def run(batches):
        w = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, idx, counts, bounds in hashed_rows(batch.column("_text"), orders, bits, shapes, prefixes):
                x = value(idx, counts, bounds)
                z = np.add.reduceat(w[idx] * x, bounds[:-1])
                scores[a:b] = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores)], [*names, "score"])

    slim = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text") + ", score double"
    return store.map_arrow(slim, run, schema)


def training_rows(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, orders: tuple[int, ...], bits: int, shapes: tuple[int, ...] = (), prefixes: tuple[int, ...] = ()) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """Features of the picked rows, sorted by id: (id, label, buckets, counts).

    `picked` (id, label) is bounded by the caller's row limit, which is why it may be
    broadcast and why its features may go to the driver.
    """
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked.select(F.col(id_col).alias("_id"), F.col("label").cast("double").alias("label"))), "_id")

    def run(batches):
        for batch in batches:
            idx_rows, count_rows = [], []
            for _, _, idx, counts, bounds in hashed_rows(batch.column("_text"), orders, bits, shapes, prefixes):
                cuts = bounds[1:-1]
                idx_rows += [x.astype(np.int32).tobytes() for x in np.split(idx, cuts)]
                count_rows += [np.minimum(x, 60000).astype(np.uint16).tobytes() for x in np.split(counts, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("label"), pa.array(idx_rows, pa.binary()), pa.array(count_rows, pa.binary())], ["_id", "label", "idx", "counts"])

    got = store.map_arrow(chosen.select("_id", "label", "_text"), run, "_id long, label double, idx binary, counts binary").collect()
    rows = [(r["_id"], r["label"], np.frombuffer(r["idx"], dtype=np.int32), np.frombuffer(r["counts"], dtype=np.uint16)) for r in got]
    return sorted(rows, key=lambda r: (r[0], r[1], r[2].tobytes()))


def bounded(rows: DataFrame, id_col: str, limit: int, seed: int) -> DataFrame:
    """At most `limit` rows, the same ones at every layout: smallest seeded hash of the id."""
    return rows.filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(limit)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))
