"""Quality scores by a linear support vector machine over naive-Bayes-scaled indicators.

Each text is the set of its hashed tokens and token pairs. A feature present in a text has the value of its log-count
ratio between the classes (Wang and Manning, 2012), divided by the square root of the text's number of features; a
linear hinge-loss model is fitted to that by dual coordinate descent (Hsieh et al., 2008), and its margins are turned
into probabilities on rows that the fit did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from ._common import fold, ready, unit_hash


@dataclass
class Model:
    weights: np.ndarray  #: by feature, the log-count ratio included
    bias: float
    slope: float  #: of the logistic curve over margins
    offset: float

    def __call__(self, doc: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        margin = np.bincount(doc, self.weights[feat], minlength=n) / np.sqrt(size) + self.bias
        return linear.sigmoid(self.slope * margin + self.offset)


def log_count_ratio(x: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of (share of class 1's feature counts) / (share of class 0's), by feature."""
    size = 1 << linear.BITS
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(a for a, b in zip(x, y, strict=True) if b == side)]), minlength=size) + smooth for side in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, rounds: int, seed: int) -> np.ndarray:
    """Weights (the bias last) of the L2-regularised hinge-loss model; rows: (features, values), y: +1 or -1, cost: each row's limit."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            slack = y[i] * (w[f] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[f] += step * y[i] * v
                w[-1] += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a weak pull to (2, 0)."""
    at = np.array([2.0, 0.0])
    for _ in range(50):
        p = linear.sigmoid(at[0] * margin + at[1])
        g = np.array([((p - y) * weight * margin).sum(), ((p - y) * weight).sum()]) + 0.1 * (at - [2.0, 0.0])
        c = weight * p * (1 - p)
        h = np.array([[(c * margin**2).sum(), (c * margin).sum()], [(c * margin).sum(), c.sum()]]) + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        at = at - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 1e-6)), float(at[1])


def train(x: list[np.ndarray], y: np.ndarray, share: dict[int, float], cost: float = 1.0, rounds: int = 12, seed: int = 7) -> Model:
    """share: how often each class occurs among all labelled rows; one class only gives a constant score."""
    size = 1 << linear.BITS
    if len(set(y.tolist())) < 2:
        p = float(y[0]) if len(y) else 0.5
        return Model(np.zeros(size), 0.0, 1.0, 4.0 if p == 1 else -4.0 if len(y) else 0.0)
    held = np.arange(len(y)) % 5 == 4
    if len({*y[held].tolist()}) < 2 or len({*y[~held].tolist()}) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    ratio = log_count_ratio([x[i] for i in fit], y[fit])
    rows = [(x[i], ratio[x[i]] / max(1.0, np.sqrt(len(x[i])))) for i in fit]
    n1 = y[fit].mean()
    limit = np.where(y[fit] == 1, cost * 0.5 / n1, cost * 0.5 / (1 - n1))
    w = dual_coordinate_descent(rows, np.where(y[fit] == 1, 1.0, -1.0), limit, size, rounds, seed)
    model = Model(w[:-1] * ratio, float(w[-1]), 1.0, 0.0)
    test = np.flatnonzero(held) if held.any() else fit
    margin = np.array([model.weights[x[i]].sum() / np.sqrt(max(1, len(x[i]))) + model.bias for i in test])
    seen = {c: max(1, int((y[test] == c).sum())) for c in (0, 1)}
    weight = np.array([share.get(int(c), 0.5) * len(test) / seen[int(c)] for c in y[test]])
    model.slope, model.offset = platt(margin, y[test].astype(float), weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, most_features: int = linear.MOST_FEATURES, seed: int = 7) -> Model:
    """Train on at most `most` labelled documents of each class and most_features of their features, chosen by a hash of doc_id.

    labels: doc_id and the label (0 or 1; other values and nulls are left out; of repeated rows the smallest label
    counts). Training runs in a task; the driver gets the model only.
    """
    ready(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, most / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, most / max(1, n.get(0, 0)))))
    # the sample is bounded by `most`, so broadcasting it is safe at any corpus size
    sample = known.where(unit_hash(F.col("doc_id"), F.lit(seed)) < rate)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    total = sum(n.values()) or 1
    share = {k: v / total for k, v in n.items()}
    return linear.learnt(texts, ["y"], seed, lambda rows, x: train(x, np.array([y for (y,) in rows], np.int64), share, seed=seed), most_features=most_features)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep and score: the chance, 0 to 1, that the whole text has label 1. Null and empty texts get the bias's."""
    ready(docs.sparkSession)
    return linear.scored(docs, keep, model)


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 4, out: int = 2, at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the fold `out` of crc32(doc_id) is never learnt from.

    Null texts count as empty and get the bias's score; without usable labels every score is 0.5. Very long texts count
    whole; a score of exactly `at` is predicted 1; equal texts have equal scores. Repeated rows get a row each, extra
    columns of docs are ignored, an empty table gives an empty result.
    """
    d = docs.select("doc_id", "text")
    seen = fold(F.col("doc_id"), parts) != out
    model = fit(d, labels.where(seen))
    return score(d, model, ["doc_id"]).select(
        "doc_id", (fold(F.col("doc_id"), parts) == out).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted")
    )
