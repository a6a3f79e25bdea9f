"""Packing by concatenate and cut.

Pass 1 tokenises each document once and stores its ids with its place in its partition
(running token total). The partitions' totals are summed up in order; that prefix sum
gives every document its global token offset. Pass 2 cuts the endless sequence into fixed
windows: a document that crosses a window's end is split there, one piece a window.

Rules: a null text is empty and packs as the separator alone. Repeated rows are packed
each. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textcore

WINDOW = 1024
SEPARATOR = 0
_CACHED = 1_000_000
_ODD = re.compile("[%s]" % "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))))


class Encoder:
    """Byte-level BPE ids of whole texts, each distinct chunk of a block encoded once.

    A chunk is a run of ASCII white space with the run of other bytes after it. The
    vocabulary's splitting pattern never joins a non-space with a following space, so the
    ids of a text are those of its chunks in order. Texts with other Unicode white space
    are encoded whole.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.empty()

    def empty(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint16)
        self.bounds = np.zeros(1 << 16, dtype=np.int64)
        self.count = 0

    def _store(self, keys: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Add chunks whose ids lie one after another in `ids`, ending at `ends`."""
        base, n = int(self.bounds[self.count]), len(keys)
        while base + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + n + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[base : base + len(ids)] = ids
        self.bounds[self.count + 1 : self.count + 1 + n] = base + ends
        self.place.update(zip(keys, range(self.count, self.count + n), strict=True))
        self.count += n

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of consecutive texts (UTF-8 bytes and offsets), and the texts' bounds in them."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.uint16), np.zeros(len(offsets), dtype=np.int64)
        if self.count > _CACHED:
            self.empty()
        space = textcore._SPACE[data]
        cut = np.zeros(n, dtype=bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys, first, which = np.unique(textcore.segment_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        place, names = self.place, keys.tolist()
        slots = np.fromiter((place.get(k, -1) for k in names), dtype=np.int64, count=len(names))
        new = np.flatnonzero(slots < 0)
        alone = ~space[starts[first[new]]] | space[ends[first[new]] - 1]  # white space alone would join with the next chunk's
        joined = new[~alone]  # these begin with a space and end with none, so they can be encoded in one string
        if len(joined):
            a, b = starts[first[joined]], ends[first[joined]]
            raw = data.tobytes()
            text = b"".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]).decode("utf-8")
            ids = np.array(self.encoding.encode_ordinary(text), dtype=np.uint16)
            at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(b - a), side="left") + 1
            self._store([names[k] for k in joined.tolist()], ids, at)
        for k in new[alone].tolist():
            ids = np.array(self.encoding.encode_ordinary(data[starts[first[k]] : ends[first[k]]].tobytes().decode("utf-8")), dtype=np.uint16)
            self._store([names[k]], ids, np.array([len(ids)]))
        slots[new] = [place[names[k]] for k in new.tolist()]
        slots = slots[which]
        size = self.bounds[slots + 1] - self.bounds[slots]
        after = np.cumsum(size)
        out = self.ids[np.repeat(self.bounds[slots] - (after - size), size) + np.arange(after[-1])]
        return out, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]

    def texts(self, column: pa.Array):
        """ids of each text of a column."""
        data, offsets = textcore.flat(column)
        for a, b in textcore.blocks(offsets, 1 << 22):
            part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            whole = part.tobytes().decode("utf-8") if len(part) and part.max() > 127 else ""
            if whole and _ODD.search(whole):
                for x, y in zip(local[:-1].tolist(), local[1:].tolist(), strict=True):
                    text = part[x:y].tobytes().decode("utf-8")
                    if _ODD.search(text):
                        yield np.array(self.encoding.encode_ordinary(text), dtype=np.uint16)
                    else:
                        yield self.block(part[x:y], np.array([0, y - x]))[0]
                continue
            ids, bounds = self.block(part, local)
            yield from (ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path, pattern)


def tokenised(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, begin (tokens before it in its partition), ids (uint16, separator last); stored."""

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        encode = encoder(path, pattern)
        for batch in batches:
            ids = [np.append(x, np.uint16(SEPARATOR)) for x in encode.texts(batch.column("_text"))]
            after = total + np.cumsum([len(x) for x in ids])
            begin = after - [len(x) for x in ids]
            total = int(after[-1]) if len(ids) else total
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([part] * len(ids), pa.int32()), pa.array(begin, pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], ["doc_id", "part", "begin", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return store.stored(store.map_arrow(slim, run, "doc_id long, part int, begin long, ids binary"), "tokens")


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Full windows, but for the last one of the corpus.
    """
    tokens = tokenised(docs, path, pattern, id_col, text_col)
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.max(F.col("begin") + F.octet_length("ids") / 2).cast("long").alias("n")).collect()}
    offsets, run_total = {}, 0
    for part in sorted(totals):  # a number for each input partition
        offsets[part] = run_total
        run_total += totals[part]
    shared = docs.sparkSession.sparkContext.broadcast(offsets)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        place = shared.value
        for batch in batches:
            out, pieces = [], []
            for doc, part, begin, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                wide = np.frombuffer(raw, dtype="<u2").astype("<u4")
                at, n, start = place[part] + begin, len(wide), 0
                while start < n:
                    length = min(window - (at + start) % window, n - start)
                    piece = wide[start : start + length]
                    out.append((doc, start, length, zlib.crc32(piece.tobytes()), n, (at + start) // window, (at + start) % window))
                    if with_ids:
                        pieces.append(piece)
                    start += length
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(pieces).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return store.map_arrow(tokens.select("doc_id", "part", "begin", "ids"), run, schema)
