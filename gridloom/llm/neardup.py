"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles (ASCII-lower-cased words; with fewer words
than a shingle, the whole sequence as one; without words, empty and linked with nothing).
Two bijections of the 32-bit universe make all signature coordinates: sigma scatters the
shingles once, coordinate k is the minimum of pi(sigma(x) - k). Bands of five coordinates
are so many that a pair at the threshold is missed with probability 1e-8 at most.

Documents with equal sets form classes (key: 128 bits of the set), and only classes are
compared. Candidates of a bucket are verified in two steps that never list all pairs:

1. each class against the smallest key of its bucket, then connected components;
2. in buckets that still hold several components, classes of different components
   against each other, in blocks of bounded size; a block emits only links that join
   components it still holds apart.

So components are those of the full link graph, while a bucket of m classes that link to
one another costs m comparisons. Shingles are compared by 64-bit hashes.

Rules: repeated rows are equal documents; null texts and texts without words stand alone;
null ids get the smallest id of their component, null if there is none. Extra columns are
ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textcore

SHINGLE, BAND_ROWS, MISS = 5, 5, 1e-8
BLOCK_SHINGLES = 1 << 20

_C1, _C2 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)


def band_count(threshold: float) -> int:
    """Bands for which a pair at the threshold is missed with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**BAND_ROWS)))


def shingle_sets(column: pa.Array, n: int = SHINGLE):
    """For row ranges [a, b) of a text column: sorted distinct shingle hashes, row bounds."""
    data, offsets = textcore.flat(column)
    for a, b in textcore.blocks(offsets):
        h, bounds = textcore.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, *textcore.row_unique(*textcore.ngrams(h, bounds, n, short_whole=True))


def set_keys(u: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's set; None for an empty one."""
    one, two = (textcore.reduce_rows(np.add, textcore.mix64(u ^ np.uint64(salt)), bounds, 0) for salt in (0x51ED270B, 0xA24BAED4963EE407))
    sizes = np.diff(bounds).astype(np.uint64)
    raw = np.stack([textcore.mix64(one + sizes), two], axis=1).astype(">u8")
    return [raw[i].tobytes() if sizes[i] else None for i in range(len(sizes))]


def circulant_signatures(u: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """coordinates x rows (rows must not be empty): minimum of pi(sigma(x) - k)."""
    sigma = (textcore.mix64(u ^ np.uint64(0x6A09E667F3BCC908)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((coordinates, len(bounds) - 1), dtype=np.uint32)
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 15), side="right")) - 1)
        values, at = sigma[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        work, high = np.empty_like(values), np.empty_like(values)
        for k in range(coordinates):
            np.subtract(values, np.uint32(k), out=work)
            work *= _C1
            np.right_shift(work, np.uint32(15), out=high)
            work ^= high
            work *= _C2
            np.right_shift(work, np.uint32(16), out=high)
            work ^= high
            out[k, a:b] = np.minimum.reduceat(work, at)
        a = b
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """rows x bands: one hash a band, also of the band's number."""
    k, rows = signatures.shape
    out = np.empty((rows, k // BAND_ROWS), dtype=np.int64)
    for band in range(k // BAND_ROWS):
        h = np.full(rows, np.uint64(band + 1) * np.uint64(0x9E3779B97F4A7C15))
        for r in range(BAND_ROWS):
            h = textcore.mix64(h * np.uint64(0x9FB21C651E98DF25) + signatures[band * BAND_ROWS + r].astype(np.uint64))
        out[:, band] = h.view(np.int64)
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def document_signatures(docs: DataFrame, id_col: str, text_col: str, bands: int) -> DataFrame:
    """doc_id, n (set size), key, bands of every document; stored."""

    def run(batches):
        for batch in batches:
            for a, b, u, bounds in shingle_sets(batch.column("_text")):
                live = np.flatnonzero(np.diff(bounds) > 0)
                packed = np.append(bounds[live], bounds[-1])
                hashes = band_hashes(circulant_signatures(u, packed, bands * BAND_ROWS)) if len(live) else np.zeros((0, bands), dtype=np.int64)
                per_row = np.zeros(b - a, dtype=np.int64)
                per_row[live] = bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(set_keys(u, bounds), pa.binary()), _lists(hashes.ravel(), np.concatenate([[0], np.cumsum(per_row)]))],
                    ["doc_id", "n", "key", "bands"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return store.stored(store.map_arrow(slim, run, "doc_id long, n long, key binary, bands array<long>"), "signatures")


def components(edges: DataFrame) -> DataFrame:
    """key, comp (smallest key reachable) for every key on an edge (a, b); stored.

    Alternating large-star and small-star rounds; each round is written to shared storage.
    """
    pairs = store.stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    state = mark(pairs)
    while True:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.greatest("b", "low").alias("b"), "low", "a")
        following = small.select(F.col("a"), F.col("low").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("low").alias("b"))).filter("a != b").distinct()
        following = store.stored(following, "links")
        now = mark(following)
        store.dropped(pairs)
        pairs = following
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("key"), F.col("b").alias("comp")).unionByName(pairs.select(F.col("b").alias("key"), F.col("b").alias("comp"))).distinct()


def _join_block(keys: list[bytes], comps: list[bytes], sizes: np.ndarray, values: np.ndarray, bounds: np.ndarray, side: np.ndarray, percent: int):
    """Links (a, b) between different components of a block that still join two of them."""
    parent = {c: c for c in comps}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    if len(parent) < 2:
        return
    _, ids = np.unique(values, return_inverse=True)
    marked = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    counts: dict[bytes, int] = {}
    for c in comps:
        counts[c] = counts.get(c, 0) + 1
    largest = max(counts, key=counts.get)
    for i in range(len(keys)):
        if comps[i] == largest:
            continue  # links to it are found from the other end
        mine = ids[bounds[i] : bounds[i + 1]]
        marked[mine] = 1
        shared = np.add.reduceat(marked[ids], bounds[:-1])
        marked[mine] = 0
        linked = 100 * shared >= percent * (sizes + sizes[i] - shared)
        if side is not None:
            linked &= side != side[i]
        for j in np.flatnonzero(linked).tolist():
            x, y = find(comps[i]), find(comps[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield comps[i], comps[j]


def _block_links(percent: int):
    names = ["a", "b"]

    def run(batches):
        current, held, out = None, [], []

        def finish():
            keys = [k for t in held for k in t[0]]
            comps = [c for t in held for c in t[1]]
            values, sizes = np.concatenate([t[2] for t in held]), np.concatenate([t[3] for t in held])
            side = np.concatenate([t[4] for t in held])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            out.extend(_join_block(keys, comps, sizes, values, bounds, side if len(set(side.tolist())) > 1 else None, percent))

        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("h", "p", "q")), strict=True))
            sets = batch.column("items")
            offsets = sets.offsets.to_numpy()
            values = sets.values.to_numpy(zero_copy_only=False)
            a = 0
            while a < len(groups):
                b = a
                while b < len(groups) and groups[b] == groups[a]:
                    b += 1
                if groups[a] != current:
                    if held:
                        finish()
                    current, held = groups[a], []
                held.append((batch.column("key").slice(a, b - a).to_pylist(), batch.column("comp").slice(a, b - a).to_pylist(), values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]), batch.column("block").slice(a, b - a).to_numpy()))
                a = b
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names)
                out = []
        if held:
            finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sig = document_signatures(docs, id_col, text_col, band_count(percent / 100))
    some = sig.filter("n > 0")
    classes = some.groupBy("key").agg(F.min("doc_id").alias("rep"))
    own = some.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))  # equal for equal sets
    spread = own.select("key", "n", F.explode("bands").alias("h"))
    buckets = spread.groupBy("h").agg(F.min("key").alias("center"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("key")).alias("mark")).filter("m > 1")
    # buckets of the same classes are one bucket
    buckets = buckets.groupBy("center", "m", "weight", "mark").agg(F.min("h").alias("h"))
    members = store.stored(spread.join(buckets, "h").select("h", "key", "n", "center", "m", "weight"), "members")

    wanted = members.select("key").distinct().join(classes, "key")
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = text.join(wanted.select(F.col("rep").alias("_id"), "key"), "_id").select("_text", "key")
    # a class that only null ids hold has no row to ask for: its text is among theirs
    found = found.unionByName(text.filter(F.col("_id").isNull() & F.col("_text").isNotNull()).select("_text", F.lit(None).cast("binary").alias("key")))

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for a, b, u, bounds in shingle_sets(batch.column("_text")):
                own = set_keys(u, bounds)
                same = [k is not None and keys[a + i] in (None, k) for i, k in enumerate(own)]
                made = pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), _lists(u.view(np.int64), bounds)], ["key", "items"])
                yield made.filter(pa.array(same))

    sets = store.map_arrow(found, run, "key binary, items array<long>").join(wanted.select("key"), "key", "left_semi")
    sets = store.stored(sets.groupBy("key").agg(F.first("items").alias("items")), "sets")  # one row a set, however often it occurs
    pairs = members.filter("key != center").select("key", "center").distinct()
    left = pairs.join(sets, "key").select("key", "center", F.col("items").alias("_left"))
    both = left.join(sets.select(F.col("key").alias("center"), F.col("items").alias("_right")), "center")
    shared = F.size(F.array_intersect("_left", "_right"))
    union = F.size("_left") + F.size("_right") - shared
    first = components(both.filter(100 * shared >= percent * union).select(F.col("key").alias("a"), F.col("center").alias("b")))

    # what the first step leaves apart
    labelled = members.filter("m > 2").join(first, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    labelled = store.stored(labelled, "labelled")
    mixed = labelled.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("h")
    blocks = F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int")
    ready = labelled.join(mixed, "h", "left_semi").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    ready = ready.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ready = ready.select("h", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "comp").join(sets, "key")
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ready = ready.repartition(tasks, "h", "p", "q").sortWithinPartitions("h", "p", "q", "key").select("h", "p", "q", "block", "key", "comp", "items")
    second = components(store.map_arrow(ready, _block_links(percent), "a binary, b binary"))

    final = classes.join(first, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    final = final.join(second.select(F.col("key").alias("comp"), F.col("comp").alias("last")), "comp", "left").select("key", "rep", F.coalesce("last", "comp").alias("comp"))
    names = final.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = final.join(names, "comp").select("key", "component_id")
    out = sig.select("doc_id", "n", "key").join(labels, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
