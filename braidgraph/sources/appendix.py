"""Files of haplotypes to append: paths or walks with numeric nodes, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import numbered
from .gfa import ORDER, fields, lines_of

PATH = r"^P[ \t]+\S+[ \t]+[0-9]*[1-9][0-9]*[+-](?:,[0-9]*[1-9][0-9]*[+-])*(?:[ \t].*)?$"
WALK = r"^W[ \t]+\S+[ \t]+[0-9]+[ \t]+\S+[ \t]+(?:[0-9]+|\*)[ \t]+(?:[0-9]+|\*)[ \t]+(?:[<>][0-9]*[1-9][0-9]*)+[ \t]*$"


class BadAppendix(ValueError):
    """A file that cannot be appended."""


def read_appendix(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame]:
    """kind ('P' or 'W'), the records (line_no and the table's columns) and their steps (line_no, pos, snode)."""
    lines = numbered(lines_of(spark, path).where(~F.col("value").rlike(r"^\s*$")), ORDER, "line_no", 1)
    kind = F.left("value", F.lit(1))
    ok = F.when(kind == "P", F.col("value").rlike(PATH)).when(kind == "W", F.col("value").rlike(WALK)).otherwise(kind.isin("H", "#"))
    bad = lines.where(~ok).agg(F.min("line_no")).first()[0]
    if bad is not None:
        raise BadAppendix(f"line {bad}: no path, walk, header or comment, or a malformed one")
    kinds = {r[0] for r in lines.select(kind).distinct().collect()} & {"P", "W"}
    if len(kinds) != 1:
        raise BadAppendix("paths and walks mixed" if kinds else "nothing to append")
    f = fields(F.col("value"))
    if kinds == {"P"}:
        rows = lines.where(kind == "P").select("line_no", f[1].alias("name"), F.regexp_extract("value", r"^P[ \t]+\S+[ \t]+\S+[ \t]*(.*)$", 1).alias("overlaps"), F.split(f[2], ",").alias("t"))
        node = F.expr("cast(substr(tok, 1, length(tok) - 1) as bigint)")
        reverse = F.right("tok", F.lit(1)) == "-"
        meta = rows.select("line_no", "name", "overlaps")
    else:
        end = lambda i: F.when(f[i] != "*", f[i].cast("bigint"))
        rows = lines.where(kind == "W").select("line_no", f[1].alias("sample_id"), f[2].cast("bigint").alias("hap_index"), f[3].alias("seq_id"), end(4).alias("seq_start"), end(5).alias("seq_end"), F.regexp_extract_all(f[6], F.lit("[><][0-9]+"), F.lit(0)).alias("t"))
        node = F.expr("cast(substr(tok, 2) as bigint)")
        reverse = F.left("tok", F.lit(1)) == "<"
        meta = rows.drop("t")
    steps = rows.select("line_no", F.posexplode("t").alias("pos", "tok")).select("line_no", F.col("pos").cast("bigint").alias("pos"), F.when(reverse, -node).otherwise(node).alias("snode"))
    return kinds.pop(), meta, steps
