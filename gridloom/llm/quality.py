"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal.

The n-grams are of words and of word shapes (letter case, symbols, length, repetition).

Rules: null and empty texts have only the bias feature and get its score. Extra
columns of the inputs are ignored. Rows with the same id are scored each by its own
text. With no usable labels every score is 0.5. Null labels and null ids train nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

ORDERS, SHAPES, BITS = (1, 2), (1, 2), 18


def unit_log(idx: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Word n-grams: log(1 + count) scaled to length 1/2 in each row. Shape n-grams: their
    share of the row's. The bias (first of a row) stays 1."""
    first, sizes = bounds[:-1], np.diff(bounds)
    shape = idx >= 1 << (BITS - 1)
    x = np.where(shape, counts, np.log1p(counts)).astype(np.float32)
    x[first] = 0
    norm = 2 * np.sqrt(np.add.reduceat(np.where(shape, 0, x * x), first))
    total = np.add.reduceat(np.where(shape, x, 0), first)
    x /= np.where(shape, np.repeat(np.maximum(total, 1e-6), sizes), np.repeat(np.maximum(norm, 1e-6), sizes))
    x[shape] *= 4
    x[first] = 1
    return x


def ftrl(rows: list, bits: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Follow-the-regularised-leader weights: per-coordinate steps, sparse by l1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    order = np.random.default_rng(7)
    prepared = [(y, idx, unit_log(idx, counts, np.array([0, len(counts)])).astype(np.float64)) for _, y, idx, counts in rows]

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(prepared)):
            y, idx, x = prepared[k]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
    return weights(z, n)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000, seed: int = 11) -> np.ndarray:
    """FTRL weights from at most max_rows labelled rows (smallest seeded hash of the id)."""
    usable = labels.select(id_col, F.col(label_col).alias("label")).filter(F.col("label").isNotNull()).groupBy(id_col).agg(F.max("label").alias("label"))
    picked = features.bounded(usable, id_col, max_rows, seed)
    rows = features.training_rows(docs, picked, id_col, text_col, ORDERS, BITS, SHAPES)
    if len({y for _, y, _, _ in rows}) < 2:
        return np.zeros(1 << BITS)
    return ftrl(rows, BITS)


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep columns, score in 0..1 for every whole text."""
    return features.score_texts(docs, id_col, text_col, ORDERS, BITS, unit_log, weights, keep, SHAPES)
