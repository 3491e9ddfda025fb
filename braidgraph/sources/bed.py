"""Window files: chromosome, start, end and, if given, a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import numbered
from .gfa import ORDER, lines_of


class BadBed(ValueError):
    """Text that is no list of windows."""


def parsed_bed(lines: DataFrame) -> DataFrame:
    """ORDER columns, chrom, start, end, name, ok of all lines but blank ones and comments."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i: F.when(at(i).rlike("^[0-9]+$"), at(i).try_cast("bigint"))
    rows = lines.where(~F.col("value").rlike(r"^\s*$|^#")).select(*ORDER, at(0).alias("chrom"), number(1).alias("start"), number(2).alias("end"), at(3).alias("_name"))
    name = F.coalesce("_name", F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    return rows.select(*ORDER, "chrom", "start", "end", name.alias("name"), (F.col("start").isNotNull() & F.col("end").isNotNull() & F.coalesce(F.col("end") >= F.col("start"), F.lit(False))).alias("ok"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """wid (in file order), chrom, start, end, name. Raises BadBed for malformed lines, reversed windows and empty files."""
    rows = parsed_bed(lines_of(spark, path))
    n, good = rows.agg(F.count("*"), F.count_if("ok")).first()
    if not n:
        raise BadBed("no windows")
    if good < n:
        raise BadBed("malformed window: " + str(rows.where("not ok").limit(1).collect()[0].asDict()))
    return numbered(rows, ORDER, "wid").select("wid", "chrom", "start", "end", "name")
