"""Paths and walks by name, as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render

WALK_KEY = ["sample_id", "hap_index", "seq_id", "seq_start", "seq_end"]


class NotFound(LookupError):
    """A requested traversal is not in the graph."""


class Ambiguous(LookupError):
    """A name stands for more than one traversal."""


def joined_steps(steps: DataFrame, kind: str, keys: list[str] = ("trav",), names: DataFrame | None = None) -> DataFrame:
    """keys and text: the tokens of each traversal, in order; with names (node_id, name) by name instead of number."""
    token, glue = (render.path_token, ",") if kind == "P" else (render.walk_token, "")
    if names is None:
        shown = token(F.col("snode"))
    else:
        steps = steps.join(names.select(F.col("node_id").alias("_id"), F.col("name").alias("_name")), F.abs("snode") == F.col("_id"), "left")
        shown = token(F.col("snode"), F.coalesce("_name", F.abs("snode").cast("string")))
    row = F.struct("pos", shown.alias("t"))
    return steps.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), glue).alias("text"))


def path_lines(requests: DataFrame, paths: DataFrame, steps: DataFrame) -> DataFrame:
    """req_idx, line of requests (req_idx, name); only the steps of requested paths are read together."""
    asked = requests.join(paths, "name")
    wanted = steps.join(asked.select("trav").distinct(), "trav", "left_semi")
    text = joined_steps(wanted, "P")
    return asked.join(text, "trav", "left").select("req_idx", render.path_line(F.col("name"), F.coalesce("text", F.lit("")), F.col("overlaps")).alias("line"))


def walk_lines(requests: DataFrame, walks: DataFrame, steps: DataFrame) -> DataFrame:
    """req_idx, line of requests (req_idx and the five key columns); of equal walks the first."""
    first = walks.groupBy(*WALK_KEY).agg(F.min("trav").alias("trav"))
    r, w = requests.alias("r"), first.alias("w")
    same = F.lit(True)
    for c in WALK_KEY:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}"))
    asked = r.join(w, same).select("req_idx", *(F.col(f"r.{c}") for c in WALK_KEY), "w.trav")
    text = joined_steps(steps.join(asked.select("trav").distinct(), "trav", "left_semi"), "W")
    return asked.join(text, "trav", "left").select("req_idx", render.walk_line(*(F.col(c) for c in WALK_KEY), F.coalesce("text", F.lit(""))).alias("line"))


def duplicated(table: DataFrame, column: str) -> DataFrame:
    """column, n of values that occur more than once."""
    return table.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def extract_paths(names: list[str], paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Lines in request order; raises Ambiguous if any stored name repeats, NotFound for an unknown name."""
    spark = paths.sparkSession
    if duplicated(paths, "name").limit(1).count():
        raise Ambiguous("path names repeat")
    requests = spark.createDataFrame(list(enumerate(names)), "req_idx bigint, name string")
    missing = requests.join(paths, "name", "left_anti").limit(1).collect()
    if missing:
        raise NotFound(missing[0]["name"])
    return path_lines(requests, paths, steps.where("kind = 'P'")).orderBy("req_idx")


def extract_walks(keys: list[tuple], walks: DataFrame, steps: DataFrame) -> DataFrame:
    """Lines in request order of walks given by sample, haplotype, sequence, start, end (None: *)."""
    requests = walks.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(keys)], "req_idx bigint, sample_id string, hap_index bigint, seq_id string, seq_start bigint, seq_end bigint")
    r, w = requests.alias("r"), walks.alias("w")
    same = F.lit(True)
    for c in WALK_KEY:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}"))
    missing = r.join(w, same, "left_anti").limit(1).collect()
    if missing:
        raise NotFound(f"walk not found: {missing[0].asDict()}")
    return walk_lines(requests, walks, steps.where("kind = 'W'")).orderBy("req_idx")


def extract_walks_by_sample(samples: list[str], walks: DataFrame, steps: DataFrame) -> DataFrame:
    """Lines in request order; the sample column must be unique."""
    if duplicated(walks, "sample_id").limit(1).count():
        raise Ambiguous("sample names repeat")
    rows = walks.sparkSession.createDataFrame(list(enumerate(samples)), "req_idx bigint, sample_id string").join(walks, "sample_id")
    if rows.count() != len(samples):
        raise NotFound("sample not found")
    return walk_lines(rows.select("req_idx", *WALK_KEY), walks, steps.where("kind = 'W'")).orderBy("req_idx")
