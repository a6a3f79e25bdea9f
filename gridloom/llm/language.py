"""Language identification by rank-order n-gram profiles.

A profile is a ranked list of the most frequent letter n-grams (n = 1..3) of a
language, counted over all training texts; words are lower-cased and padded by one
blank on each side. A text's own ranked list is compared to each profile by the
out-of-place distance: the sum of rank differences, a missing n-gram costing the
profile size. The score is 1 minus the distance over its maximum.

Rules: a null text, or one without a letter, gives `und` and score 0. Ties in counts
rank by the n-gram's code; ties in distance go to the smaller language name. Without
profiles everything is `und`. Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textcore

SIZE = 300
_BLANK = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for anything that is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def _codes(raw: bytes) -> np.ndarray:
    """Letters of a UTF-8 text with every run of other characters as one blank, blank-padded."""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    c = _letters()[points]
    c = np.concatenate([[0], c, [0]]).astype(np.uint64)
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    keep[0] = True
    c = c[keep]
    c[c == 0] = _BLANK
    return c


def text_ngrams(raw: bytes) -> np.ndarray | None:
    """Codes of all 1- to 3-grams of a text (21 bits a character); None without a letter."""
    c = _codes(raw)
    if len(c) < 3:
        return None
    one = c[c != _BLANK]
    two = c[:-1] | (c[1:] << np.uint64(21))
    three = c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42))
    three = three[c[1:-1] != _BLANK]
    return np.concatenate([one, two, three])


def _counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[at], np.diff(np.append(at, len(g)))


def _ranked(g: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, most frequent first, equal counts by code."""
    codes, counts = _counted(g)
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> dict[str, np.ndarray]:
    """Profiles of every non-null language from all given texts.

    Counts are summed in each task before the shuffle; what reaches the driver is
    `size` rows a language.
    """

    def run(batches):
        sums: dict[str, list[np.ndarray]] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def fold(lang):
            codes, counts = _counted(np.concatenate(sums.pop(lang)))
            if lang in totals:
                both = np.concatenate([totals[lang][0], codes])
                codes, place = np.unique(both, return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([totals[lang][1], counts])).astype(np.int64)
            totals[lang] = (codes, counts.astype(np.int64))

        for batch in batches:
            data, offsets = textcore.flat(batch.column("_text"))
            for i, lang in enumerate(batch.column("_lang").to_pylist()):
                g = text_ngrams(data[offsets[i] : offsets[i + 1]].tobytes())
                if g is not None:
                    sums.setdefault(lang, []).append(g)
                    held += len(g)
                if held > 4_000_000:
                    for x in list(sums):
                        fold(x)
                    held = 0
        for x in list(sums):
            fold(x)
        for lang, (codes, counts) in totals.items():
            for a in range(0, len(codes), 20000):
                c = codes[a : a + 20000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c.astype(np.int64)), pa.array(counts[a : a + 20000])], ["lang", "gram", "n"])

    slim = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_lang is not null and _text is not null")
    counts = store.map_arrow(slim, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= size)
    out: dict[str, list] = {}
    for r in ranked.collect():
        out.setdefault(r["lang"], []).append((r["k"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], dtype=np.uint64) for lang, rows in sorted(out.items())}


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep columns, lang_pred, score for every whole text."""
    langs = list(profiles)
    every = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, dtype=np.uint64)
    ranks = np.full((len(langs), len(every) + 1), -1, dtype=np.int32)
    for i, x in enumerate(langs):
        ranks[i, np.searchsorted(every, profiles[x])] = np.arange(len(profiles[x]))

    def guess(raw: bytes) -> tuple[str, float]:
        g = text_ngrams(raw) if langs else None
        if g is None:
            return "und", 0.0
        mine = _ranked(g, size)
        at = np.minimum(np.searchsorted(every, mine), len(every) - 1)
        at[every[at] != mine] = len(every)
        theirs = ranks[:, at]
        distance = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
        k = int(distance.argmin())
        return langs[k], 1.0 - float(distance[k]) / (size * len(mine))

    def run(batches):
        for batch in batches:
            data, offsets = textcore.flat(batch.column("_text"))
            found = [guess(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(batch.num_rows)]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*names, "lang_pred", "score"])

    slim = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text") + ", lang_pred string, score double"
    return store.map_arrow(slim, run, schema)
