"""The corpus pipeline: language, near duplicates, personal data, mixing, tokens; each stage works on what is left.

Every stage takes all rows of docs, whole texts, and columns of any name. Null columns are allowed everywhere, repeated
rows are rows like others, and an empty table goes through all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from braidgraph.functions.staging import scratch
from braidgraph.llm import langid, mixing, neardup, pii, queries, sp_encode
from braidgraph.llm._common import documents, work_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those far from every learnt language go.

    Null and empty texts and texts without a letter go; equal texts stay or go alike; rows with a null lang are judged
    like others. With no lang at all nothing is known, and all go.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts: the one with the smallest doc_id.

    Where that id repeats or is null any one row of the group stays. Null texts all stay; empty and wordless texts are
    groups of equal texts.
    """
    return neardup.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data, n_chars brought up to date. Null and empty texts stay as they are.

    Raises pii.Collision if two entities of the corpus would share a surrogate, or one would have two.
    """
    return pii.with_surrogates(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all to three times. A null source is a source.

    Null and empty texts stay once. Of documents of one source and size, those with the smallest hash of doc_id come
    more often; of rows with one doc_id any.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars (as far as there) of each document with its tokens' number and digests.

    Null texts count as empty: two tokens.
    """
    keep = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    return sp_encode.digests(docs, queries.model_path(), keep)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing_weights),
    ("tokens", tokens),
]
#: No SQL can express the classifiers and the encoder; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet in the shared folder and read again.

    What a stage needed goes when its result is written, and a result when the next one is.
    """
    where = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(where).getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        if before:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{before}"), True)
        docs, before = spark.read.parquet(f"{where}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
