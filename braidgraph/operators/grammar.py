"""Rules that stand for repeated pairs of symbols, and their expansion.

A round takes the pairs that occur at least twice (in either direction), replaces them from left to right without
overlap, keeps the rules that were used, and numbers them by their packed pair. Where a pair may be replaced at several
places in a row, these form an island; taking every second place of an island from its start is what replacing from
left to right gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packing
from ..functions.staging import numbered, staged
from . import traversal


class BadRules(ValueError):
    """A rulebook that can't be written out."""


def replaced(steps: DataFrame, keys: list[str], rules: DataFrame, block: int = traversal.BLOCK) -> DataFrame:
    """keys, pos, snode, rule: steps (with dense positions) with rules (kmer, rule) applied; positions are those of the
    pairs' first symbols.

    A pair found in reverse becomes the negative rule. Islands are followed across blocks by the place at which they start.
    """
    pair = traversal.beside(steps.select(*keys, "pos", "snode"), keys, F.col("snode"), "_next", 1, block)
    pair = pair.withColumn("kmer", F.when(F.col("_next").isNotNull(), packing.canonical(F.col("snode"), F.col("_next"))))
    known = pair.join(rules.select("kmer", "rule"), "kmer", "left").withColumn("_hit", F.col("rule").isNotNull())
    starts = traversal.beside(known, keys, F.col("_hit"), "_hit0", -1, block).withColumn("_start", F.when(F.col("_hit") & ~F.coalesce("_hit0", F.lit(False)), F.col("pos")))
    island = traversal.running(starts, keys, "_start", "_from", block, F.max)
    picked = island.withColumn("_pick", F.col("_hit") & ((F.col("pos") - F.col("_from")) % 2 == 0))
    forward = packing.pack(F.col("snode"), F.col("_next")) == F.col("kmer")
    out = traversal.beside(picked, keys, F.col("_pick"), "_gone", -1, block).where(~F.coalesce("_gone", F.lit(False)))
    sign = F.when(forward, F.col("rule")).otherwise(-F.col("rule"))
    return out.select(*keys, "pos", F.when(F.col("_pick"), sign).otherwise(F.col("snode")).alias("snode"), F.col("_pick").alias("rule"))


def compacted(steps: DataFrame, keys: list[str], block: int = traversal.BLOCK) -> DataFrame:
    """steps with positions 0, 1, 2, ..."""
    return traversal.running(steps.withColumn("_1", F.lit(1).cast("bigint")), keys, "_1", "_n", block).withColumn("pos", F.col("_n") - 1).drop("_1", "_n")


def round_of(steps: DataFrame, keys: list[str], base: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(steps after one round, rules: rule_id, kmer, first, second), rule ids from base + 1 by packed pair."""
    found = traversal.repeated(traversal.two_mers(steps, keys), least)
    # candidates get ids in pair order; unused ones are dropped and the rest closed up, which keeps the order
    candidates = numbered(found.select("kmer"), ["kmer"], "rule", base + 1)
    coded = staged(replaced(steps.select(*keys, "pos", "snode"), keys, candidates), "coded")
    used = coded.where("rule").select(F.abs("snode").alias("rule")).distinct()
    rules = numbered(candidates.join(used, "rule", "left_semi").select("kmer", "rule"), ["kmer"], "rule_id", base + 1)
    new = coded.join(rules.select(F.col("rule").alias("_old"), "rule_id"), (F.abs("snode") == F.col("_old")) & F.col("rule"), "left")
    out = new.select(*keys, "pos", F.when(F.col("rule"), F.signum("snode").cast("long") * F.col("rule_id")).otherwise(F.col("snode")).alias("snode"))
    return compacted(out, keys), rules.select("rule_id", "kmer", packing.unpack_first(F.col("kmer")).alias("first"), packing.unpack_second(F.col("kmer")).alias("second"))


def encode(steps: DataFrame, keys: list[str], rounds: int = 8, delta: int = 1, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(encoded steps, rules with their round) after delta coding and up to `rounds` rounds; stops when no pair repeats."""
    now = staged(traversal.delta(steps.select(*keys, "pos", "snode"), keys, delta), "delta")
    base = now.agg(F.max(F.abs("snode"))).first()[0] or 0
    if delta > 1:  # ids start after the largest symbol of every round of deltas
        for r in range(1, delta):
            base = max(base, traversal.delta(steps.select(*keys, "pos", "snode"), keys, r).agg(F.max(F.abs("snode"))).first()[0] or 0)
    book = None
    for r in range(rounds):
        new, rules = round_of(now, keys, base, least)
        rules = staged(rules, "rules")
        n = rules.count()
        if not n:
            break
        now, base = staged(new, "steps"), base + n
        rules = rules.withColumn("round", F.lit(r + 1))
        book = rules if book is None else book.unionByName(rules)
    if book is None:
        book = now.sparkSession.createDataFrame([], "rule_id bigint, kmer bigint, first bigint, second bigint, round int")
    return now, book


def leaves(rules: DataFrame) -> DataFrame:
    """rule_id, leaf (array of symbols): each rule written out, children before parents, to any depth.

    Raises BadRules if rules stand for one another in a circle, so that they have no end.
    """
    table = staged(rules.select("rule_id", "first", "second"), "rules")
    ids = table.select(F.col("rule_id").alias("_id"))
    turned = lambda x, leaf: F.when(F.col(leaf).isNull(), F.array(x)).when(F.col(x) > 0, F.col(leaf)).otherwise(F.reverse(F.transform(leaf, lambda v: -v)))
    # whether a side is a rule is looked up once; a round writes out those whose sides are symbols or written out already
    todo = staged(table.join(ids.withColumnRenamed("_id", "_a"), F.abs("first") == F.col("_a"), "left").join(ids.withColumnRenamed("_id", "_b"), F.abs("second") == F.col("_b"), "left"), "todo")
    done: DataFrame | None = None
    while todo.limit(1).count():
        if done is None:
            ready = todo.where("_a is null and _b is null").select("rule_id", F.array("first", "second").alias("leaf"))
        else:
            k1, k2 = (done.select(F.col("rule_id").alias(f"_k{i}"), F.col("leaf").alias(f"_l{i}")) for i in (1, 2))
            both = todo.join(k1, F.col("_a") == F.col("_k1"), "left").join(k2, F.col("_b") == F.col("_k2"), "left").where("(_a is null or _k1 is not null) and (_b is null or _k2 is not null)")
            ready = both.select("rule_id", F.concat(turned("first", "_l1"), turned("second", "_l2")).alias("leaf"))
        ready = staged(ready, "ready")
        if not ready.limit(1).count():
            raise BadRules("rules that stand for one another")
        done = ready if done is None else done.unionByName(ready)
        todo = staged(todo.join(ready.select("rule_id"), "rule_id", "left_anti"), "todo")
    return done if done is not None else table.select("rule_id", F.array("first", "second").alias("leaf"))


def expand(steps: DataFrame, keys: list[str], rules: DataFrame, block: int = traversal.BLOCK) -> DataFrame:
    """keys, pos, snode with all rules written out (a negative rule in reverse, with all signs turned).

    Where a symbol's leaves go follows from the lengths before it, summed block by block.
    """
    table = leaves(rules)
    wide = steps.select(*keys, "pos", "snode").join(table.select(F.col("rule_id").alias("_r"), "leaf"), F.abs("snode") == F.col("_r"), "left")
    wide = wide.withColumn("_n", F.when(F.col("leaf").isNull(), F.lit(1)).otherwise(F.size("leaf")).cast("bigint"))
    placed = traversal.running(wide, keys, "_n", "_to", block)
    parts = F.when(F.col("leaf").isNull(), F.array("snode")).when(F.col("snode") > 0, F.col("leaf")).otherwise(F.reverse(F.transform("leaf", lambda v: -v)))
    return placed.select(*keys, (F.col("_to") - F.col("_n")).alias("_at"), F.posexplode(parts).alias("_i", "_s")).select(*keys, (F.col("_at") + F.col("_i")).cast("long").alias("pos"), F.col("_s").alias("snode"))


def lengths(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: steps of each traversal."""
    return steps.groupBy(*keys).agg(F.count("*").alias("n"))


def decode(steps: DataFrame, keys: list[str], rules: DataFrame, delta: int = 1) -> DataFrame:
    """The traversals that encode() was given."""
    return traversal.undelta(expand(steps, keys, rules), keys, delta)


def encode_with(steps: DataFrame, keys: list[str], rules: DataFrame, delta: int = 1) -> DataFrame:
    """New traversals coded with a stored rulebook, round by round; no rules are added.

    Raises if a symbol after delta coding would be taken for a rule.
    """
    now = traversal.delta(steps.select(*keys, "pos", "snode"), keys, delta)
    first = rules.agg(F.min("rule_id")).first()[0]
    if first is not None and now.where(F.abs("snode") >= first).limit(1).count():
        raise ValueError("a symbol of the new traversals is as large as a rule id")
    for (r,) in sorted(map(tuple, rules.select("round").distinct().collect())):
        now = compacted(replaced(now, keys, rules.where(F.col("round") == r).select("kmer", F.col("rule_id").alias("rule"))).drop("rule"), keys)
    return now
