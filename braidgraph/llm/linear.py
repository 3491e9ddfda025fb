"""Sparse linear scoring shared by the quality and toxicity classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import textfeat

BITS = 20


def featured(docs: DataFrame, keep: list[str], pairs: bool = True) -> DataFrame:
    """Columns keep and x: the text's distinct hashed features, as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for _, part in textfeat.chunks(texts):
                doc, feat = textfeat.indicators(part, BITS, pairs)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                out += [feat[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.binary())], names=[*keep, "x"])

    schema = StructType([docs.schema[k] for k in keep]).add("x", "binary")
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


#: Features of all rows together that a fit takes: 80 MB. Rows beyond, by the order of their hash, are left out of the sample.
MOST_FEATURES = 20_000_000


def learnt(sample: DataFrame, keep: list[str], seed: int, fit: Callable[[list[tuple], list[np.ndarray]], object], pairs: bool = True, most_features: int = MOST_FEATURES) -> object:
    """fit(rows' columns keep, rows' features), called in one task over sample (doc_id, text, keep): the model alone reaches the driver.

    Rows come in the order of a hash of doc_id, then of their features, one batch at a time, and are held as features
    until there are most_features of them.
    """
    rows = featured(sample.withColumn("_o", F.xxhash64("doc_id", F.lit(seed))), ["_o", *keep], pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, x, total = [], [], 0
        for b in batches:
            for row, features in zip(zip(*(b.column(k).to_pylist() for k in keep), strict=True), b.column("x").to_pylist(), strict=True):
                total += len(features) // 4
                if total <= most_features:
                    columns.append(row)
                    x.append(np.frombuffer(features, "<i4"))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(columns, x))], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions("_o", "x").mapInArrow(run, "model binary")
    row = one.first()
    return fit([], []) if row is None else pickle.loads(row["model"])  # no rows, no task


def scored(docs: DataFrame, keep: list[str], score: Callable[[np.ndarray, np.ndarray, int], np.ndarray], pairs: bool = True) -> DataFrame:
    """Columns keep and score; score takes text indices, features and the number of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(score)  # 2^BITS weights: its size does not depend on the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text").to_pylist(), [np.zeros(0)]
            for _, part in textfeat.chunks(texts):
                out.append(shared.value(*textfeat.indicators(part, BITS, pairs), len(part)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(np.concatenate(out), pa.float64())], names=[*keep, "score"])

    schema = StructType([StructField(k, docs.schema[k].dataType) for k in keep]).add("score", "double")
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
