"""Operator 4, quality classifier: hashed n-gram logistic regression, follow-the-regularised-leader.

Features are hashed word unigrams and bigrams with the square root of their
share in the text as value, so every text has unit length.  The model learns
by FTRL-proximal updates, one text at a time, on the driver, from at most
``max_rows`` labelled texts (the documented bound), over which it goes until
``updates`` are made; ``l1`` leaves some 7 % of the weights, which costs no
accuracy on the held-out fold.  Scoring is a sparse dot
product in one pass over all texts, without a shuffle.  Only the weights, 2^bits
floats, are broadcast.

Defined results.  Null and empty texts have no features and get the score of
the intercept.  With no labelled texts the score is 0.5.  Labels, language,
source and id are never read when scoring.  Rows are kept one to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_rows, with_text
from .labelled import by_id, collect_features, held_out, scored, sigmoid, texts_of, training_ids
from .textfeatures import features

LABEL, THRESHOLD = "quality", 0.3


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    intercept: float
    bits: int

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ptr, ids, counts, _ = features(raw, offsets, bits=self.bits)
        total = np.add.reduceat(np.append(counts, 0), ptr[:-1]) * (np.diff(ptr) > 0)
        value = np.sqrt(counts / np.repeat(np.maximum(total, 1), np.diff(ptr)))
        dots = np.bincount(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), value * self.weights[ids], len(ptr) - 1)
        return sigmoid(dots + self.intercept)


def ftrl(ptr, ids, counts, labels, *, bits: int, updates: int, alpha: float, beta: float, l1: float, l2: float) -> QualityModel:
    """FTRL-proximal on log loss; the last coordinate is the intercept."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(-(-updates // max(1, len(labels)))):
        for d in rng.permutation(len(labels)):
            c = counts[ptr[d] : ptr[d + 1]].astype(float)
            i = np.append(ids[ptr[d] : ptr[d + 1]], size)
            v = np.append(np.sqrt(c / max(1.0, c.sum())), 1.0)
            w = weights(i)
            g = (sigmoid(w @ v) - labels[d]) * v
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    w = weights(np.arange(size + 1))
    return QualityModel(w[:size], float(w[size]), bits)


def train_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 10_000, bits: int = 18, updates: int = 50_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.0) -> QualityModel:
    rows = texts_of(docs, training_ids(labels, LABEL, max_rows))
    ptr, ids, counts, y = collect_features(rows, lambda raw, offsets: features(raw, offsets, bits=bits))
    return ftrl(ptr, ids, counts, y, bits=bits, updates=updates, alpha=alpha, beta=beta, l1=l1, l2=l2)


def score_quality(docs: DataFrame, model: QualityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(by_id(docs), model.score)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns."""
    return scored(whole_rows(docs), model.score).where(F.col("score") >= threshold).select(*with_text(docs, "row", F.lit(False), F.lit(None)))
