"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

The CGK random walk reads a sequence of words: at step j it notes the word under its
pointer and moves on if bit j of that word's random code is one. Two sequences at a small
edit distance meet again after each edit, so their walks agree in most places: edit
distance has become Hamming distance. A repetition samples places of the walk and hashes
what was noted there; each length class has as many as find RECALL of its items when
`tolerance` of their words is edited (`repetitions`, which also counts what the choice of
windows below loses).

Windows have the size of the items: items fall into length classes, and an item's class
sets how long its walks are and from which places they are sampled. Documents are walked
from every STRIDE-th word; each item is walked from every offset that leaves it a window,
so that a leak at any place meets a grid point. Only windows of which PAIRS of the adjacent
unit pairs occur in items are walked: an edited unit breaks two pairs, so one with a third
of its units edited keeps as many. A document's windows that share a sample with an item
are verified: the item's edit distance (code points of the lower-cased words)
to its best place in the document there must be at most `tolerance` of its length.

Units are words, or code points without white space for items with few blanks (scripts
that write none, long words). Items below MIN_WORDS units are too short for walks: every
exact occurrence is found by hashes of all runs of their length, and verified likewise.

Rules: null and empty texts and items match nothing. Repeated rows are judged each. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textcore

STRIDE, SAMPLES, MIN_WORDS, PAIRS = 4, 4, 9, 0.3
RECALL, TRIALS, MOST_REPEATS = 0.95, 1000, 256
CLASSES = (6, 12, 20, 32, 48)
UNITS_PER_PASS = 1 << 17
POINTS = 16
#: South-east Asian scripts, kana, Han and their marks.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3130), (0x31A0, 0xA000), (0xF900, 0xFB00), (0xFE30, 0xFE50), (0xFF00, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x32000))
_STEPS = {w: w * 4 // 3 for w in CLASSES}
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


@lru_cache(MOST_REPEATS)
def _places(repeat: int) -> dict[int, np.ndarray]:
    """Sampled steps of each class in a repetition, ascending."""
    rng = np.random.default_rng(1000 + repeat)
    return {w: np.sort(rng.choice(_STEPS[w], SAMPLES, replace=False)) for w in CLASSES}


def walks(h: np.ndarray, starts: np.ndarray, repeat: int, classes) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Sample hash of each class for walks over h from each start, and the last word each read."""
    places = {w: set(p.tolist()) for w, p in _places(repeat).items() if w in classes}
    last = {w: max(p) for w, p in places.items()}
    padded = np.concatenate([h, np.zeros(_STEPS[max(classes)] + 1, dtype=np.uint64)])
    codes = textcore.mix64(padded ^ np.uint64(0xC2B2AE3D27D4EB4F + repeat))
    at = starts.astype(np.int64)
    found = {w: np.full(len(starts), np.uint64(w * 1024 + repeat)) for w in places}
    read = {}
    for step in range(max(last.values()) + 1):
        for w, p in places.items():
            if step in p:
                found[w] = (found[w] ^ padded[at]) * _MULTIPLIER
                found[w] ^= found[w] >> np.uint64(31)
                if step == last[w]:
                    read[w] = at.copy()
        at += ((codes[at] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
    return found, read


def unit_pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each unit with the one behind it."""
    return textcore.mix64(h[:-1] * _MULTIPLIER + h[1:]) if len(h) else h


class Pairs:
    """The adjacent unit pairs of all items."""

    BITS = 22

    def __init__(self, pairs: np.ndarray):
        self.pairs = np.unique(pairs)
        self.near = np.zeros(1 << self.BITS, dtype=bool)
        self.near[self.pairs >> np.uint64(64 - self.BITS)] = True

    def upto(self, h: np.ndarray) -> np.ndarray:
        """Number of pairs of h known here, before each unit."""
        own = unit_pairs(h)
        at = np.flatnonzero(self.near[own >> np.uint64(64 - self.BITS)])
        place = np.searchsorted(self.pairs, own[at])
        known = np.zeros(len(h) + 1, dtype=np.int32)
        known[1 + at[self.pairs[np.minimum(place, len(self.pairs) - 1)] == own[at]]] = 1
        return np.cumsum(known)


def dense_windows(upto: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """True for starts of windows of w units with PAIRS of their pairs known."""
    last = len(upto) - 1
    return upto[np.minimum(starts + w - 1, last)] - upto[np.minimum(starts, last)] >= int(np.ceil(PAIRS * (w - 1)))


@lru_cache
def repetitions(w: int, tolerance: float, recall: float = RECALL) -> int:
    """Repetitions after which `recall` of a class's items share a sample with a window.

    Items of the class's least lengths, which have the fewest windows, get `tolerance` of
    their words replaced, dropped or followed by a new one at random places, at any phase
    of the grid.
    """
    rng = np.random.default_rng(w)
    sizes = max(MIN_WORDS, w + STRIDE - 1) + np.arange(STRIDE)
    items, copies, item_of, begins, grid_of, grid = [], [], [], [], [], []
    at = place = 0
    for t in range(TRIALS):
        n = int(sizes[t % len(sizes)])
        item = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        copy = [[x] for x in item.tolist()]
        for k in rng.choice(n, int(round(tolerance * n)), replace=False).tolist():
            new = int(rng.integers(0, 1 << 63))
            copy[k] = ([new], [], [copy[k][0], new])[int(rng.integers(3))]
        copy = [x for part in copy for x in part]
        around = rng.integers(0, 1 << 63, 2 * w + 2 * STRIDE, dtype=np.uint64)
        lead = int(rng.integers(STRIDE))
        points = np.arange(-lead % STRIDE, len(copy), STRIDE)
        items.append(np.append(item, around[: 2 * w]))
        copies.append(np.append(np.array(copy, dtype=np.uint64), around))
        begins.append(at + np.arange(n - w + 1))
        item_of.append(np.stack([np.full(n - w + 1, t), np.full(n - w + 1, at + n)]))
        grid.append(place + points)
        grid_of.append(np.full(len(points), t))
        at, place = at + len(items[-1]), place + len(copies[-1])
    h, other, begins, grid, grid_of = (np.concatenate(x) for x in (items, copies, begins, grid, grid_of))
    item_of, stop = np.concatenate(item_of, axis=1)
    dense = dense_windows(Pairs(unit_pairs(h)).upto(other), grid, w)
    grid, grid_of = grid[dense], grid_of[dense]
    found = np.zeros(TRIALS, dtype=bool)
    for r in range(MOST_REPEATS):
        keys, read = walks(h, begins, r, [w])
        good = read[w] < stop
        mine = keys[w] ^ textcore.mix64(item_of.astype(np.uint64))
        theirs = walks(other, grid, r, [w])[0][w] ^ textcore.mix64(grid_of.astype(np.uint64))
        found[grid_of[np.isin(theirs, mine[good])]] = True
        if found.mean() >= recall:
            return r + 1
    return MOST_REPEATS


class Words:
    """The words of a block of rows as units: their hashes `h` and the rows' `bounds`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.bounds = textcore.words(data, offsets)
        self.data, (self.starts, self.ends) = data, textcore.stripped(data, starts, ends)
        self.h = textcore.segment_hashes(data, self.starts, self.ends, lower=True)

    def region(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        """Code points of units x to y, and the unit of each less x."""
        return _points(self.data, self.starts[x:y], self.ends[x:y])

    def word(self, unit: int, row: int) -> int:
        """Number in its row of the word a unit is in."""
        return unit - int(self.bounds[row])


class Points:
    """The code points of the lower-cased words of a block of rows as units."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = textcore.words(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = np.frombuffer(textcore._LOWER[data].tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        inside = ~textcore._SPACE[data[lead]]
        self.codes, lead = codes[inside], lead[inside]
        self.bounds = np.searchsorted(lead, offsets).astype(np.int64)
        self.of, self.first = np.searchsorted(starts, lead, side="right") - 1, first
        self.h = textcore.mix64(self.codes.astype(np.uint64) + np.uint64(1))

    def region(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        return self.codes[x:y], np.arange(y - x)

    def word(self, unit: int, row: int) -> int:
        return int(self.of[unit]) - int(self.first[row])


def unit_of(text: str) -> type:
    """Points for texts of few blanks: POINTS code points a word or more, or mostly of
    scripts that write no blanks."""
    words = text.split()
    codes = [ord(c) for w in words for c in w]
    bare = sum(any(a <= c < b for a, b in UNSPACED) for c in codes)
    return Points if len(codes) >= POINTS * len(words) or 2 * bare > len(codes) else Words


def _blocks(column: pa.Array, unit: type):
    data, offsets = textcore.flat(column)
    for a, b in textcore.blocks(offsets):
        yield a, b, unit(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased words with one blank between, and the word index of each."""
    parts = [textcore._LOWER[data[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    text = " ".join(parts)
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), np.repeat(np.arange(len(parts)), sizes)[: len(text)]


def best_place(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of the item to a substring of the region, and the substring."""
    m = len(region)
    index = np.arange(m + 1)
    cost, begin = np.zeros(m + 1, dtype=np.int64), index.copy()
    for i, c in enumerate(item, 1):
        swap = np.append(i, cost[:-1] + (region != c))
        drop = cost + 1
        drop[0] = i
        step = np.minimum(swap, drop)
        origin = np.where(swap <= drop, np.append(0, begin[:-1]), begin)
        level = step - index
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, index, 0))
        cost, begin = low + index, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


def may_hold(item: np.ndarray, region: np.ndarray, most: int) -> bool:
    """False if no substring of the region is within `most` edits of the item: an edit
    destroys at most q of its q-grams, and all others occur in the region."""
    for q in (2, 3, 4):
        if min(len(item), len(region)) < q:
            continue
        a, b = (sum(x[i : len(x) - q + 1 + i].astype(np.uint64) << np.uint64(16 * i) for i in range(q)) for x in (item, region))
        if int(np.isin(a, b).sum()) < len(a) - q * most:
            return False
    return True


class Items:
    """Sample hashes of all items at all offsets, and hashes of whole short items; sorted,
    with what they stand for."""

    def __init__(self, ids: list[int], texts: list[str], tolerance: float, unit: type = Words):
        self.ids, self.unit, self.points, self.sizes = ids, unit, [], []
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        column = pa.array(texts, pa.string())
        self.repeats: dict[int, int] = {}
        pairs: list[np.ndarray] = []
        keys: dict[int, list[np.ndarray]] = defaultdict(list)
        what: dict[int, list[np.ndarray]] = defaultdict(list)
        for a, b, seen in _blocks(column, unit):
            h, bounds = seen.h, seen.bounds
            for i in range(a, b):
                x, y = int(bounds[i - a]), int(bounds[i - a + 1])
                n = y - x
                self.sizes.append(n)
                self.points.append(seen.region(x, y)[0])
                if n < MIN_WORDS:
                    if n:
                        short[n].append((int(textcore.ngrams(h[x:y], np.array([0, n]), n)[0][0]), i))
                    continue
                pairs.append(unit_pairs(h[x:y]))
                w = max(c for c in CLASSES if c <= n - STRIDE + 1)
                offsets = np.arange(n - w + 1)
                self.repeats[w] = repetitions(w, tolerance)
                for r in range(self.repeats[w]):
                    found, read = walks(h[x:y], offsets, r, [w])
                    good = read[w] < n  # the walk stayed inside the item
                    keys[r].append(found[w][good])
                    what[r].append(np.stack([np.full(int(good.sum()), i), offsets[good]], axis=1).astype(np.int32))
        self.pairs = Pairs(np.concatenate(pairs)) if pairs else None
        self.keys, self.what = [], []
        for r in range(len(keys)):
            k = np.concatenate(keys[r])
            order = np.argsort(k, kind="stable")
            self.keys.append(k[order])
            self.what.append(np.concatenate(what[r])[order])
        self.short = {n: tuple(np.array(c, dtype=t) for c, t in zip(zip(*sorted(found), strict=True), (np.uint64, np.int32), strict=True)) for n, found in short.items()}

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (item, unit where the item would begin, row of the window that matched)
        over all windows of h."""
        out = set()
        starts = np.arange(0, len(h), STRIDE)
        upto = self.pairs.upto(h) if self.pairs else None
        for w, repeats in self.repeats.items():
            begin = starts[dense_windows(upto, starts, w)]
            if not len(begin):
                continue
            rows = np.searchsorted(bounds, begin, side="right") - 1
            reach = _STEPS[w] + 1  # a walk reads no further
            if len(begin) * reach < len(h):
                own = np.concatenate([h, np.zeros(reach, dtype=np.uint64)])[begin[:, None] + np.arange(reach)].ravel()
                at = np.arange(len(begin)) * reach
            else:
                own, at = h, begin
            for r in range(repeats):
                keys, found = self.keys[r], walks(own, at, r, [w])[0][w]
                left = np.searchsorted(keys, found)
                for i in np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == found):
                    for item, offset in self.what[r][left[i] : int(np.searchsorted(keys, found[i], side="right"))].tolist():
                        out.add((item, int(begin[i]) - offset, int(rows[i])))
        for n, (keys, item) in self.short.items():
            g, own = textcore.ngrams(h, bounds, n)
            left, right = np.searchsorted(keys, g), np.searchsorted(keys, g, side="right")
            for i in np.flatnonzero(right > left).tolist():
                row = int(np.searchsorted(own, i, side="right")) - 1
                begin = i - int(own[row]) + int(bounds[row])
                out.update((int(k), begin, row) for k in item[left[i] : right[i]])
        return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", tolerance: float = 0.2) -> DataFrame:
    """One row per leak: doc_id, item_id, first_word, last_word, distance, item_chars.

    The items come to the driver one by one and are searched in passes of UNITS_PER_PASS
    words or code points, which bounds what is indexed and broadcast at once (some 16 bytes a
    unit and repetition). Each pass reads the documents; all work on a document happens where
    it is read and nothing is shuffled.
    """
    spark = docs.sparkSession
    names = ["doc_id", "item_id", "first_word", "last_word", "distance", "item_chars"]
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = ", ".join(f"{n} long" for n in names)

    def search(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                ids = batch.column("_id")
                out = [(ids[i].as_py(), *leak) for i, leak in leaks_in(index, batch.column("_text"), tolerance)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

        return run

    out = None
    for index in _indexes(items, item_col, item_text_col, tolerance):
        found = store.map_arrow(slim, search(spark.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", tolerance: float = 0.2) -> DataFrame:
    """The rows that hold no item, as they are. Each is judged where it is read."""
    at = docs.columns.index(text_col)

    def search(shared):
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for i, _ in leaks_in(shared.value, batch.column(at), tolerance):
                    clean[i] = False
                yield batch.filter(pa.array(clean))

        return run

    for index in _indexes(items, item_col, item_text_col, tolerance):
        docs = store.map_arrow(docs, search(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


def leaks_in(index: Items, column: pa.Array, tolerance: float):
    """(row, leak) of each leak in a text column."""
    for a, _, seen in _blocks(column, index.unit):
        found = index.candidates(seen.h, seen.bounds)
        for i in np.unique(found[:, 2]).tolist():
            for leak in verified(index, found[found[:, 2] == i], seen, i, tolerance):
                yield a + i, leak


def _indexes(items: DataFrame, item_col: str, item_text_col: str, tolerance: float):
    """The index of each pass."""
    rows = items.select(item_col, item_text_col).filter(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).orderBy(item_col, item_text_col).toLocalIterator()
    for part, unit in _passes(rows):
        yield Items([i for i, _ in part], [t for _, t in part], tolerance, unit)


def verified(index: Items, found: np.ndarray, seen, row: int, tolerance: float):
    """item_id, first_word, last_word, distance, item_chars of the candidates that are leaks."""
    low, high = int(seen.bounds[row]), int(seen.bounds[row + 1])
    for item in np.unique(found[:, 0]).tolist():
        n, points, covered = index.sizes[item], index.points[item], low - 1
        slack = 4 + n // 4 if n >= MIN_WORDS else 0  # short ones match exactly
        begins, k = np.unique(found[found[:, 0] == item, 1]).tolist(), 0
        while k < len(begins):
            begin = last = begins[k]
            k += 1
            x = max(low, begin - slack)
            if begin + n // 2 <= covered or min(high, begin + n + slack) <= x:
                continue
            after = k
            while after < len(begins) and begins[after] - begin <= slack // 2:
                last, after = begins[after], after + 1
            region, unit = seen.region(x, min(high, last + n + slack))
            most = int(tolerance * len(points) + 1e-9)
            if not may_hold(points, region, most):
                k = after
                continue
            distance, a, b = best_place(points, region)
            if distance <= tolerance * len(points) and b > a:
                covered = x + int(unit[b - 1])
                yield index.ids[item], seen.word(x + int(unit[a]), row), seen.word(covered, row), distance, len(points)
            else:
                k = after


def _passes(rows):
    """The items (id, text) by unit, UNITS_PER_PASS of them or a single longer item at once."""
    held = {Words: [], Points: []}
    sizes = dict.fromkeys(held, 0)
    for item, text in rows:
        unit = unit_of(text)
        size = len(text.split()) if unit is Words else len(text)
        if held[unit] and sizes[unit] + size > UNITS_PER_PASS:
            yield held[unit], unit
            held[unit], sizes[unit] = [], 0
        held[unit].append((int(item), text))
        sizes[unit] += size
    for unit, part in held.items():
        if part:
            yield part, unit
