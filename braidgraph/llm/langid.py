"""Language by nearest centroid: normalised TF-IDF vectors of letter n-grams against several centroids per language.

Texts become hashed counts of 1 to 3 letters (1 + log count, times inverse document frequency, length 1). Each
language's sample is clustered by spherical k-means; a text gets the language of the centroid with the largest cosine,
and is rejected when even that one is farther than almost all training texts of its length are from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import textfeat
from ._common import fold, ready, staged, unit_hash, unstage

BITS = 13
BANDS = 24  #: lengths by powers of two, for the rejection distance
#: A text is rejected below this part of the smallest cosine among training texts of like length.
REJECT = 0.35


@dataclass
class Model:
    names: list[str]  #: language of each centroid
    centroids: np.ndarray  #: one row each
    idf: np.ndarray
    least: np.ndarray  #: smallest accepted cosine by band of length


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashed n-gram counts, and the number of letters of each text."""
    doc, feat, letters = textfeat.letter_grams(texts, BITS)
    size = 1 << BITS
    return np.bincount(doc * size + feat, minlength=len(texts) * size).reshape(len(texts), size).astype(np.float32), letters


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, letters = counts(texts)
    on = c > 0
    c[on] = 1 + np.log(c[on])
    c *= idf
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12), letters


def small(texts: list[str | None], rows: int = 64) -> Iterator[list[str]]:
    """Texts in chunks whose dense count rows stay small."""
    for _, part in textfeat.chunks(texts):
        for i in range(0, len(part), rows):
            yield part[i : i + rows]


def band(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), BANDS - 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means; starts from rows far from one another."""
    pick = [int(np.random.default_rng(seed).integers(len(x)))]
    near = x @ x[pick[0]]
    while len(pick) < min(k, len(x)):
        pick.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[pick[-1]])
    c = x[pick]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, per_language: int = 500, centroids: int = 4, languages: int = 256, seed: int = 5) -> Model:
    """Learn from at most per_language texts of each language, drawn by hash of doc_id.

    labelled: doc_id, text, lang (null languages and null texts are left out). The `languages` values of lang with most
    rows are learnt (of equally many, the first by code point), which bounds the model: centroids * 2^BITS floats each, 33
    MB in all. Each language is clustered in a task of its own, whose rows are chosen before the exchange; the driver gets
    centroids and sums only.
    """
    spark = labelled.sparkSession
    ready(spark)
    # rows with one id and size are drawn together, so the text itself need not be hashed; the window bounds what is taken
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", unit_hash(F.col("doc_id"), F.length("text"), F.lit(seed)).alias("u"))
    n = {r["lang"]: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not n:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.ones(1 << BITS, np.float32), np.zeros(BANDS))
    rates = F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, min(1.0, 1.3 * per_language / c))])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    taken = lambda drawn: drawn.withColumn("_r", first).where(F.col("_r") <= per_language).drop("_r")
    sample = staged(taken(rows.where(F.col("u") < F.coalesce(rates[F.col("lang")], F.lit(-1.0)))), "languages")
    left = sorted({*n} - {r["lang"] for r in sample.select("lang").distinct().collect()})
    if left:  # all rows of a language may share one id, and so be drawn or not together
        sample = staged(sample.unionByName(taken(rows.where(F.col("lang").isin(left)))), "languages")

    def chosen(g: pd.DataFrame) -> list[str]:
        return g.sort_values(["u", "text"])["text"].tolist()

    def frequency(g: pd.DataFrame) -> pd.DataFrame:
        df, texts = np.zeros(1 << BITS, np.int64), chosen(g)
        for part in small(texts):
            df += (counts(part)[0] > 0).sum(0)
        return pd.DataFrame({"n": [len(texts)], "df": [df.astype("<i8").tobytes()]})

    seen = sample.groupBy("lang").applyInPandas(frequency, "n long, df binary").collect()
    total, df = sum(r["n"] for r in seen), np.sum([np.frombuffer(r["df"], "<i8") for r in seen] or [np.zeros(1 << BITS)], axis=0)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        got = [vectors(part, idf) for part in small(chosen(g))]
        x, letters = np.concatenate([v for v, _ in got]), np.concatenate([m for _, m in got])
        x, letters = x[letters > 0], letters[letters > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "least": []})
        c = cluster(x, centroids, seed=seed)
        best, b = (x @ c.T).max(1), band(letters)
        low = np.array([best[b == j].min() if (b == j).any() else 9.0 for j in range(BANDS)])
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "c": [c.astype("<f4").tobytes()], "least": [low.tobytes()]})

    learnt = sorted(sample.groupBy("lang").applyInPandas(learn, "lang string, c binary, least binary").collect(), key=lambda r: r["lang"])
    names, rows_c = [], []
    for r in learnt:
        c = np.frombuffer(r["c"], "<f4").reshape(-1, 1 << BITS)
        names += [r["lang"]] * len(c)
        rows_c.append(c)
    low = np.min([np.frombuffer(r["least"]) for r in learnt] or [np.full(BANDS, 9.0)], axis=0)
    # a band takes the smallest of its own, the shorter and the longer one's nearest learnt value; a part of it is the limit
    known = np.flatnonzero(low < 9)
    least = np.array([low[known[np.argsort(np.abs(known - j))[:2]]].min() if len(known) else 0.0 for j in range(BANDS)])
    unstage(sample)
    return Model(names, np.concatenate(rows_c or [np.zeros((0, 1 << BITS), np.float32)]), idf, REJECT * least)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep, lang_pred, score (the cosine), rejected.

    Null texts and texts without a letter are `und`, score 0, rejected. With no language learnt all are so. Of equal
    cosines the first centroid counts: languages are in code point order.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x centroids x 2^BITS floats: bounded by the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            name, score, no = [], [], []
            for part in small(b.column("text").to_pylist()):
                x, letters = vectors(part, m.idf)
                cos = x @ m.centroids.T if m.names else np.zeros((len(part), 1))
                best = cos.argmax(1)
                top = np.clip(cos[np.arange(len(part)), best], 0, 1)
                ok = (letters > 0) & bool(m.names)
                name += [m.names[j] if k else "und" for j, k in zip(best, ok, strict=True)]
                score += np.where(ok, top, 0.0).tolist()
                no += (~ok | (top < m.least[band(letters)])).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    schema = StructType([StructField(k, docs.schema[k].dataType) for k in keep]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def language_of(docs: DataFrame, parts: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; fold `out` of crc32(doc_id) is never learnt from.

    Null and empty texts are `und` with score 0; very long texts count whole; equal cosines go to the first language by
    code point. Repeated rows get a row each; extra columns are ignored; an empty table gives an empty result.
    """
    d = docs.select("doc_id", "text", "lang")
    model = fit(d.where(fold(F.col("doc_id"), parts) != out))
    return predict(d.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", (fold(F.col("doc_id"), parts) == out).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, parts: int = 3, out: int = 1) -> DataFrame:
    """The rows of docs, unchanged, whose language is not rejected.

    Null texts and texts without a letter go; very long texts count whole; null languages are only not learnt from. Ties
    and repeated rows stay or go alike; all columns come back, whatever their names; no rows give no rows.
    """
    model = fit(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), parts) != out))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return predict(rows, model, ["row"]).where(~F.col("rejected")).select("row.*")
