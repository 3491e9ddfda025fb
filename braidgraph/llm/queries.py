"""The corpus queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, langid, mixing, neardup, pii, png_media, quality, secrets, sp_encode, toxicity
from ._common import documents
from .sql import SQL  # noqa: F401  read by the driver contract


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": lambda s, d: mixing.mix(documents(s, d)),
    "op2_language": lambda s, d: langid.language_of(documents(s, d)),
    "op3_pii": lambda s, d: pii.surrogate_report(documents(s, d)),
    "op4_quality": lambda s, d: quality.quality_scores(documents(s, d), table(s, d, "labels")),
    "op5_secrets": lambda s, d: secrets.secret_spans(documents(s, d)),
    "op6_near_duplicates": lambda s, d: neardup.duplicate_classes(documents(s, d)),
    "op7_sentencepiece": lambda s, d: sp_encode.token_digests(documents(s, d), model_path()),
    "op8_media": lambda s, d: png_media.media_digests(documents(s, d)),
    "op9_toxicity": lambda s, d: toxicity.toxicity_scores(documents(s, d), table(s, d, "labels")),
    "op10_neighbours": lambda s, d: ann.nearest(table(s, d, "embeddings")),
}
