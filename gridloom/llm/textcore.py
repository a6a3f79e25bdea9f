"""Vectorised text primitives over Arrow string columns.

Texts stay one flat UTF-8 byte buffer per block. Segments of the buffer (words,
chunks) get 64-bit hashes from a wrapping polynomial prefix sum, so the cost is a
few numpy passes over the bytes and no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
U64 = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER64 = _LOWER.astype(np.uint64) + U64(1)
_PLAIN64 = np.arange(1, 257, dtype=np.uint64)

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i mod 2^64 for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for slot, base in ((0, _P), (1, _P_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.cumprod(table, out=table)
            _powers[slot] = table
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges [a, b) whose bytes stay near the limit; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte segment, equal for equal (lower-cased) bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER64 if lower else _PLAIN64)[data] * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ASCII white space) of a block of rows.

    Returns starts, ends (byte positions) and bounds: row i has words
    bounds[i]:bounds[i+1]. A word never crosses a row.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at either end; a word of punctuation alone stays whole."""
    at = np.concatenate([[0], np.cumsum(~_MARK[data])])
    solid = np.flatnonzero(~_MARK[data])
    has = at[ends] > at[starts]
    a, b = starts.copy(), ends.copy()
    a[has] = solid[at[starts[has]]]
    b[has] = solid[at[ends[has]] - 1] + 1
    return a, b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block of rows, and the rows' bounds."""
    starts, ends, bounds = words(data, offsets)
    return segment_hashes(data, starts, ends, lower=True), bounds


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int, short_whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams within rows, and their bounds.

    short_whole: a row with 1 to n-1 words gives its whole sequence as one gram.
    """
    sizes = np.diff(bounds)
    counts = np.maximum(sizes - n + 1, 0)
    m = len(h) - n + 1
    if m > 0:
        g = np.zeros(m, dtype=np.uint64)
        for i in range(n):
            g = (g + h[i : i + m]) * U64(0x9FB21C651E98DF25) if i else h[:m] * U64(0x9FB21C651E98DF25)
            g ^= g >> U64(29)
        g = mix64(g + U64(n))
        keep = np.zeros(len(h) + 1, dtype=np.int32)
        live = counts > 0
        np.add.at(keep, bounds[:-1][live], 1)
        np.add.at(keep, (bounds[:-1] + counts)[live], -1)
        g = g[np.cumsum(keep)[:m] > 0]
    else:
        g = np.zeros(0, dtype=np.uint64)
    if short_whole and (short := np.flatnonzero((sizes > 0) & (sizes < n))).size:
        extra = np.empty(len(short), dtype=np.uint64)
        for j, row in enumerate(short):
            x = U64(int(sizes[row]))
            for v in h[bounds[row] : bounds[row + 1]]:
                x = _fold(x, v)
            extra[j] = x
        at = np.concatenate([[0], np.cumsum(counts)])[short]
        g = np.insert(g, at, extra)
        counts = counts.copy()
        counts[short] = 1
    return g, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _fold(x, v):
    value = (int(x) * 0x9FB21C651E98DF25 + int(v)) & 0xFFFFFFFFFFFFFFFF
    value ^= value >> 29
    return U64(value * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)


def row_unique(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their bounds."""
    if not len(g):
        return g, np.zeros(len(bounds), dtype=np.int64)
    parts = [np.sort(g[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    s = np.concatenate(parts)
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = s[1:] != s[:-1]
    inner = bounds[:-1][np.diff(bounds) > 0]
    fresh[inner] = True
    return s[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def reduce_rows(op: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty):
    """op.reduceat over rows; rows without values give `empty`."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    live = np.flatnonzero(np.diff(bounds) > 0)
    if len(live):
        out[live] = op.reduceat(values, bounds[live])
    return out


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of fixed-width values as one binary array without a copy per row."""
    size = values.dtype.itemsize
    offsets = (bounds * size).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
