"""Appending haplotypes: checks, then unions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import numbered
from ..model import PangenomeGraph
from .extract import WALK_KEY


class Conflict(ValueError):
    """What is appended cannot stand beside what is stored."""


def path_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """name, reason of new path names that repeat among themselves or exist already."""
    twice = new.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("repeated").alias("reason"))
    known = new.select("name").distinct().join(stored.select("name"), "name", "left_semi").select("name", F.lit("exists").alias("reason"))
    return twice.unionByName(known)


def walk_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The five key columns and reason of new walks that repeat or exist already; unknown ends are equal to each other."""
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("*")).alias(c) for c in WALK_KEY]
    n, s = new.select(*whole), stored.select(*whole)
    twice = n.groupBy(*WALK_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*WALK_KEY, F.lit("repeated").alias("reason"))
    return twice.unionByName(n.distinct().join(s, WALK_KEY, "left_semi").select(*WALK_KEY, F.lit("exists").alias("reason")))


def appended(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """stored (with trav) and new rows (without), numbered on from the largest trav."""
    start = stored.agg(F.coalesce(F.max("trav") + 1, F.lit(0))).first()[0]
    return stored.unionByName(numbered(new, order, "trav", start).select(*stored.columns))


def add_haplotypes(g: PangenomeGraph, kind: str, meta: DataFrame, steps: DataFrame, strict: bool = False) -> PangenomeGraph:
    """g with the given paths or walks: meta has line_no and the table's columns, steps has line_no, pos, snode.

    With strict, steps must name known segments.
    """
    name = "paths" if kind == "P" else "walks"
    stored = getattr(g, name)
    bad = (path_conflicts if kind == "P" else walk_conflicts)(meta, stored).limit(1).collect()
    if bad:
        raise Conflict(str(bad[0].asDict()))
    if strict and steps.select(F.abs("snode").alias("node_id")).join(g.segments, "node_id", "left_anti").limit(1).count():
        raise Conflict("a step names no segment")
    start = stored.agg(F.coalesce(F.max("trav") + 1, F.lit(0))).first()[0]
    ids = numbered(meta, ["line_no"], "trav", start)
    more = steps.join(ids.select("line_no", "trav"), "line_no").select(F.lit(kind).alias("kind"), "trav", "pos", "snode")
    return replace(g, **{name: stored.unionByName(ids.select(*stored.columns)), "steps": g.steps.unionByName(more)})
