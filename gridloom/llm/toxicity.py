"""Toxicity: non-negative positive-unlabelled learning of a linear text classifier.

Confirmed toxic texts are the positives, a sample of all training text is unlabelled. With class prior q the risk is  q R_p(+) + max(0, R_u(-) - q R_p(-));
when the bracket turns negative the step reverses its gradient, which keeps a flexible
model from fitting the positives inside the unlabelled text.

Rules: null and empty texts have only the bias and get its score. Extra columns are
ignored. Rows with the same id are scored each by its own text. Without positives every
score is 0. Null labels and null ids train nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

ORDERS, PREFIXES, BITS = (1,), (3, 4, 5), 19


def presence(idx: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bucket counts once a text, however long the text is."""
    return np.ones(len(counts), dtype=np.float32)


def evidence(positive: list, unlabelled: list, bits: int, least_z: float = 4.0, smoothing: float = 0.5) -> np.ndarray:
    """Scale of each bucket: log ratio of its share of positive and unlabelled texts.

    Zero where the two shares differ by less than least_z standard errors, so that the
    many ordinary words of a long text carry nothing.
    """
    size = 1 << bits
    p = np.bincount(np.concatenate([r[2] for r in positive]), minlength=size)
    u = np.bincount(np.concatenate([r[2] for r in unlabelled]), minlength=size)
    a, b = len(positive), len(unlabelled)
    pooled = (p + u) / (a + b)
    z = (p / a - u / b) / np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / a + 1 / b), 1e-12))
    scale = np.log((p + smoothing) / (a + smoothing)) - np.log((u + smoothing) / (b + smoothing))
    scale[np.abs(z) < least_z] = 0
    scale[0] = 1
    return scale


def nnpu(positive: list, unlabelled: list, prior: float, bits: int, steps: int = 600, batch: int = 512, rate: float = 0.01, l2: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights minimising the non-negative PU risk with sigmoid loss, by Adam on mini-batches."""
    scale = evidence(positive, unlabelled, bits)
    live = np.flatnonzero(scale)
    place = np.full(1 << bits, -1)
    place[live] = np.arange(len(live))

    def dense(rows):
        x = np.zeros((len(rows), len(live)), dtype=np.float32)
        for i, r in enumerate(rows):
            at = place[r[2]]
            x[i, at[at >= 0]] = 1
        return x

    s = scale[live].astype(np.float32)
    all_p, all_u = dense(positive) * s, dense(unlabelled) * s
    w, m, v = np.ones(len(live)), np.zeros(len(live)), np.zeros(len(live))
    w[place[0]] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        xp = all_p[rng.integers(0, len(all_p), min(batch, len(all_p)))]
        xu = all_u[rng.integers(0, len(all_u), min(batch, len(all_u)))]
        zp, zu = xp @ w, xu @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        dp, du = sp * (1 - sp), su * (1 - su)  # slopes of the sigmoid loss, which is bounded
        gain = -prior * xp.T @ dp / len(xp)
        bracket = su.mean() - prior * sp.mean()
        loss = xu.T @ du / len(xu) - prior * xp.T @ dp / len(xp)
        g = (gain + loss if bracket >= 0 else -loss) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(1 << bits)
    out[live] = w * s
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 6000, prior: float | None = None, seed: int = 13) -> np.ndarray:
    """nnPU weights from at most max_positive confirmed toxic and max_unlabelled texts of any kind.

    Both samples are the rows of smallest seeded hash of the id. prior: share of toxic
    texts; None takes it from the given labels.
    """
    known = labels.select(id_col, F.col(label_col).alias("y")).filter(F.col("y").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("y").alias("y"))
    if prior is None:
        prior = known.agg(F.avg("y")).first()[0] or 0.0
    toxic = features.bounded(known.filter("y = 1"), id_col, max_positive, seed).select(id_col, F.lit(1).alias("label"))
    other = features.bounded(docs.select(id_col), id_col, max_unlabelled, seed + 1).select(id_col, F.lit(0).alias("label"))
    rows = features.training_rows(docs, toxic.unionByName(other), id_col, text_col, ORDERS, BITS, prefixes=PREFIXES)
    positive, unlabelled = [r for r in rows if r[1] == 1], [r for r in rows if r[1] == 0]
    if not positive or not unlabelled:
        out = np.zeros(1 << BITS)
        out[0] = -30.0
        return out
    return nnpu(positive, unlabelled, min(max(prior, 1e-3), 0.5), BITS)


def score_toxicity(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep columns, score in 0..1 for every whole text."""
    return features.score_texts(docs, id_col, text_col, ORDERS, BITS, presence, weights, keep, prefixes=PREFIXES)
