"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positive sample, texts of unknown standing the unlabelled one. With the class prior pi the
risk of a scorer g is  pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]); when the second part turns negative its
gradient is followed upwards instead. l is the logistic loss, g a linear function of the texts' features, scaled by how
much more frequent each feature is among the positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from ._common import fold, ready, unit_hash
from .textfeat import mix64


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __call__(self, doc: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
        return linear.sigmoid(np.bincount(doc, self.weights[feat], minlength=n) + self.bias)


def contrast(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, least: int = 4, factor: float = 4.0) -> np.ndarray:
    """By feature, log of (share of positives with it) / (share of negatives with it); 0 where below log(factor) or too rare.

    The negatives' share is the unlabelled one less the prior's part of the positives', and at least its own
    uncertainty.
    """
    size, none = 1 << linear.BITS, [np.zeros(0, np.int64)]
    least = max(least, 3 * len(pos) // 1000)
    p = np.bincount(np.concatenate(none + pos), minlength=size)
    u = np.bincount(np.concatenate(none + unl), minlength=size)
    a, b = p / max(1, len(pos)), (u + 0.5) / (len(unl) + 1)
    negative = np.maximum((b - prior * a) / (1 - prior), np.sqrt(b / (len(unl) + 1)))
    sure = a - b > 4 * np.sqrt(a / (len(pos) + 1))
    ratio = np.log(np.maximum(a, 1e-12) / negative)
    return np.where((p >= least) & ((sure & (ratio > np.log(factor))) | (ratio > np.log(4 * factor))), ratio, 0.0)


def risk_steps(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Adam on the non-negative risk, whole samples at a time, over the features that contrast() keeps."""
    prior = min(max(prior, 1e-4), 0.95)
    scale = contrast(pos, unl, prior)
    kept = np.flatnonzero(scale)
    weights = np.zeros(1 << linear.BITS)
    start = float(np.log(prior / (1 - prior)))
    if not len(pos) or not len(unl) or not len(kept):
        return Model(weights, start)
    place = np.full(1 << linear.BITS, -1)
    place[kept] = np.arange(len(kept))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [c[c >= 0] for c in (place[r] for r in rows)]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols)

    (pr, pc), (ur, uc), s = sparse(pos), sparse(unl), scale[kept]
    w, b = np.zeros(len(kept)), start
    m, v, at = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    for _ in range(rounds):
        gp = np.bincount(pr, (w * s)[pc], minlength=len(pos)) + b
        gu = np.bincount(ur, (w * s)[uc], minlength=len(unl)) + b
        # loss of g as positive: log(1+exp(-g)); as negative: log(1+exp(g))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, un = linear.sigmoid(gp), linear.sigmoid(gu)
        d_pos = prior * (up - 1) / len(pos)
        d_rest_p, d_rest_u = -prior * up / len(pos), un / len(unl)
        if rest < 0:
            d_pos, d_rest_p, d_rest_u = 0 * d_pos, -d_rest_p, -d_rest_u
        dp = d_pos + d_rest_p
        grad = np.append((np.bincount(pc, dp[pr], minlength=len(kept)) + np.bincount(uc, d_rest_u[ur], minlength=len(kept))) * s + decay * w, dp.sum() + d_rest_u.sum())
        at += 1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.999**at)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[kept] = w * s
    return Model(weights, float(b))


def distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """rows without near copies: of those that share their two smallest feature hashes, the first.

    A text copied many times would make its own words look like words of its class.
    """
    seen: set[tuple[int, ...]] = set()
    out = []
    for r in rows:
        key = tuple(np.sort(mix64(r.astype(np.uint64)))[:2].tolist())
        if key not in seen:
            seen.add(key)
            out.append(r)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4000, most_unlabelled: int = 12000, most_features: int = linear.MOST_FEATURES, seed: int = 9) -> Model:
    """Train on at most `most` confirmed positives, `most_unlabelled` texts of any standing and most_features of their
    features, chosen by hash of doc_id, in a task; the driver gets the model only.

    The class prior is the share of positives among the labelled rows given. It holds for the corpus if rows were chosen
    for labelling without regard to toxicity; where toxic texts were sought out it is too large, and scores come out high.
    """
    spark = docs.sparkSession
    ready(spark)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    positives = known.where((F.col("y") == 1) & (unit_hash(F.col("doc_id"), F.lit(seed)) < min(1.0, most / max(1, n[1])))).select("doc_id", "y")
    total = docs.where(F.col("doc_id").isNotNull()).count()
    drawn = unit_hash(F.col("doc_id"), F.lit(seed + 1)) < min(1.0, most_unlabelled / max(1, total))
    # the positives are bounded by `most`, so broadcasting them is safe at any corpus size
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", drawn.alias("u")).join(F.broadcast(positives), "doc_id", "left").where(F.col("u") | F.col("y").isNotNull())
    prior = n[1] / max(1, n[0])

    def learn(rows: list[tuple], x: list[np.ndarray]) -> Model:
        positive, unlabelled = ([a for a, r in zip(x, rows, strict=True) if r[i]] for i in (0, 1))
        return risk_steps(distinct(positive), distinct(unlabelled), prior)

    return linear.learnt(texts, ["y", "u"], seed, learn, pairs=False, most_features=most_features)


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, out: int = 0, at: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the fold `out` of crc32(doc_id) is never learnt from.

    Null texts count as empty and get the prior's score; without labels every score is low. Very long texts count whole;
    a score of exactly `at` is predicted 1; equal texts have equal scores. Repeated rows get a row each, extra columns of
    docs are ignored, an empty table gives an empty result.
    """
    d = docs.select("doc_id", "text")
    seen = fold(F.col("doc_id"), parts) != out
    model = fit(d.where(seen), labels.where(seen))
    return linear.scored(d, ["doc_id"], model, pairs=False).select(
        "doc_id", (fold(F.col("doc_id"), parts) == out).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted")
    )
