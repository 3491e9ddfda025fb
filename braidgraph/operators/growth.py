"""Node coverage by groups of haplotypes, its histogram, and the expected growth curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pansn
from ..functions.staging import staged
from ..model import Grouping, PangenomeGraph

def slice_groups(g: PangenomeGraph, mode: Grouping | str) -> DataFrame:
    """kind, trav, grp of every path and walk."""
    mode = Grouping.of(mode)
    parts = []
    if g.paths is not None:
        # by path, every line is a group of its own, even if names repeat
        key = F.concat(F.lit("P"), F.col("trav").cast("string")) if mode is Grouping.PATH else pansn.growth_path_key(F.col("name"), mode)
        parts.append(g.paths.select(F.lit("P").alias("kind"), F.col("trav"), key.alias("grp")))
    if g.walks is not None:
        key = F.concat(F.lit("W"), F.col("trav").cast("string")) if mode is Grouping.PATH else pansn.walk_key(F.col("sample_id"), F.col("hap_index"), F.col("seq_id"), mode)
        parts.append(g.walks.select(F.lit("W").alias("kind"), F.col("trav"), key.alias("grp")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_nodes(g: PangenomeGraph, groups: DataFrame, num_nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (grp, node_id) over the steps of each group's traversals; ids outside the graph do not count."""
    steps = g.steps.select("kind", "trav", F.abs("snode").alias("node_id"))
    out = steps.join(groups, ["kind", "trav"]).select("grp", "node_id").distinct()
    return out.where("node_id >= 1") if num_nodes is None else out.join(num_nodes, "node_id", "left_semi")


def node_coverage(segments: DataFrame, members: DataFrame) -> DataFrame:
    """node_id, coverage: how many groups hold the node, 0 included."""
    seen = members.groupBy("node_id").agg(F.count("*").alias("coverage"))
    return segments.select("node_id").join(seen, "node_id", "left").select("node_id", F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"))


def coverage_histogram(coverage: DataFrame, groups: DataFrame) -> DataFrame:
    """c, n_nodes for every c from 0 to the number of groups."""
    bins = groups.select("grp").distinct().agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("c"))
    counts = coverage.groupBy(F.col("coverage").alias("c")).agg(F.count("*").alias("n_nodes"))
    return bins.join(counts, "c", "left").select("c", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def growth_curve(histogram: DataFrame) -> DataFrame:
    """k, growth: expected number of nodes in k of the N groups drawn at random.

    A node in c groups is missed by all k draws with probability C(N - k, c) / C(N, c), the exponential of four
    logarithms of factorials. The histogram's bins that hold nodes, and the factorials up to N, are two arrays beside each
    k, so that a k is one row and one fold, and nothing is joined; both are as long as there are groups.
    """
    histogram = staged(histogram, "histogram")
    one = histogram.where("c > 0 and n_nodes > 0").agg(F.collect_list(F.struct("c", "n_nodes")).alias("bins"))
    total = histogram.agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    spark = histogram.sparkSession
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 1, dtype=np.float64)))]) if total else np.zeros(1)
    fact = spark.createDataFrame([(logs.tolist(),)], "f array<double>")
    # two rows of N numbers, whatever the graph's size
    ks = spark.range(1, total + 1).withColumnRenamed("id", "k").join(F.broadcast(one), F.lit(True), "left").join(F.broadcast(fact), F.lit(True))
    n, k = F.lit(total), F.col("k")
    f = lambda i: F.try_element_at("f", (i + 1).cast("int"))
    missed = lambda c: F.exp(f(n - k) + f(n - c) - f(F.greatest(n - k - c, F.lit(0))) - f(n))
    some = lambda b: b["n_nodes"] * F.when(b["c"] > n - k, 1.0).otherwise(1.0 - missed(b["c"]))
    return ks.select("k", F.aggregate(F.coalesce("bins", F.array()), F.lit(0.0), lambda acc, b: acc + some(b)).alias("growth"))


def growth(g: PangenomeGraph, mode: Grouping | str = Grouping.PATH) -> DataFrame:
    """k, growth of a graph under a grouping."""
    groups = slice_groups(g, mode)
    members = group_nodes(g, groups)
    return growth_curve(coverage_histogram(node_coverage(g.segments, members), groups))


def node_groups(members: DataFrame) -> DataFrame:
    """node_id, grps: the sorted groups that hold each node."""
    return members.groupBy("node_id").agg(F.sort_array(F.collect_set("grp")).alias("grps"))


def growth_lines(curve: DataFrame) -> DataFrame:
    """k and the output line: k and the value with four decimals."""
    return curve.select("k", F.format_string("%d\t%.4f", "k", "growth").alias("line"))


def output(g: PangenomeGraph, mode: Grouping | str = Grouping.PATH) -> DataFrame:
    """k, line of the printed curve, to be sorted by k; the header's lines have k below 1."""
    mode = Grouping.of(mode)
    lines = staged(growth_lines(growth(g, mode)), "curve")
    # fixed values: the header's texts
    head = ["# growth (count=node, coverage>=1, quorum>=0)", f"# group-by={mode.value}", f"# num_haplotypes={lines.count()} num_nodes={g.segments.count()}", "k\tgrowth"]
    top = lines.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head, 1)], "k bigint, line string")
    return top.unionByName(lines.select(F.col("k").cast("bigint").alias("k"), "line"))
