"""Order-dependent transforms of traversals: deltas, running sums, 2-mers, flat arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packing
from ..functions.staging import numbered, running_total


#: Steps of a traversal that are worked on together: a longer one is spread over tasks, block by block.
BLOCK = 65_536


def beside(steps: DataFrame, keys: list[str], value: Column, name: str, by: int, block: int = BLOCK) -> DataFrame:
    """steps with `value` of the step before (by = -1) or after (by = 1) on the same traversal; null at its end.

    Positions are dense. A window is a block of a traversal, with one step of the neighbouring block as a guest.
    """
    at = F.floor(F.col("pos") / block)
    edge = (F.col("pos") % block == (block - 1 if by < 0 else 0)) & (F.col("pos") >= (0 if by < 0 else block))
    guest = F.when(edge, F.array(at, at - by)).otherwise(F.array(at))
    rows = steps.select("*", value.alias("_v"), F.explode(guest).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("pos")
    near = F.lag("_v").over(w) if by < 0 else F.lead("_v").over(w)
    return rows.withColumn(name, near).where(F.col("_b") == at).drop("_v", "_b")


def running(steps: DataFrame, keys: list[str], value: str, name: str, block: int = BLOCK, fold: Callable[[str], Column] = F.sum) -> DataFrame:
    """steps with the sum (or another fold, such as F.max) of value up to and with each step of its traversal.

    Blocks are folded on their own, and the folds of the blocks before, one row each, give where a block starts.
    """
    cut = steps.withColumn("_b", F.floor(F.col("pos") / block))
    own = cut.withColumn("_own", fold(value).over(Window.partitionBy(*keys, "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = cut.groupBy(*keys, "_b").agg(fold(value).alias("_t")).withColumn("_before", fold("_t").over(earlier)).drop("_t")
    both = own.join(start, [*keys, "_b"])
    total = F.coalesce(F.col("_own") + F.col("_before"), "_own", "_before") if fold is F.sum else fold_two(F.col("_own"), F.col("_before"))
    return both.withColumn(name, total).drop("_b", "_own", "_before")


def fold_two(a: Column, b: Column) -> Column:
    return F.greatest(a, b)  # the only other fold in use is the maximum


def delta(steps: DataFrame, keys: list[str], rounds: int = 1, value: str = "snode", block: int = BLOCK) -> DataFrame:
    """value minus its predecessor on the same traversal (the first one as it is), `rounds` times; 0 rounds change nothing."""
    out = steps
    for _ in range(rounds):
        out = beside(out, keys, F.col(value), "_before", -1, block).withColumn(value, F.col(value) - F.coalesce("_before", F.lit(0))).drop("_before")
    return out


def flat_delta(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with value minus that of the row before in the whole order, across traversals; the first stays.

    The rows are numbered range by range and meet their predecessors by number, so no task holds them all.
    """
    at = numbered(rows, order, "_n")
    before = at.select((F.col("_n") + 1).alias("_n"), F.col(value).alias("_before"))
    return at.join(before, "_n", "left").withColumn(value, F.col(value) - F.coalesce("_before", F.lit(0))).drop("_n", "_before")


def largest_symbols(steps: DataFrame, keys: list[str], rounds: int, value: str = "snode") -> DataFrame:
    """round, max_abs after 1 to `rounds` rounds of deltas (round 0: as they are, if no rounds are asked for)."""
    table = [max_symbol(delta(steps, keys, r, value), value).select(F.lit(r).alias("round"), "max_abs") for r in (range(1, rounds + 1) if rounds else [0])]
    out = table[0]
    for t in table[1:]:
        out = out.unionByName(t)
    return out


def undelta(steps: DataFrame, keys: list[str], rounds: int = 1, value: str = "snode", block: int = BLOCK) -> DataFrame:
    """Running sums, `rounds` times: undoes delta. Long traversals are summed block by block."""
    out = steps
    for _ in range(rounds):
        out = running(out, keys, value, "_sum", block).withColumn(value, F.col("_sum")).drop("_sum")
    return out


def flat_undelta(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Undoes flat_delta: running sums across the whole order, range by range."""
    return running_total(rows, order, value, "_before").withColumn(value, F.col(value) + F.col("_before")).drop("_before")


def two_mers(steps: DataFrame, keys: list[str], value: str = "snode", block: int = BLOCK) -> DataFrame:
    """keys, pos, a, b, kmer (canonical) of adjacent pairs; pairs do not cross traversals."""
    pair = beside(steps.select(*keys, "pos", F.col(value).alias("a")), keys, F.col("a"), "b", 1, block).where("b is not null")
    return pair.withColumn("kmer", packing.canonical(F.col("a"), F.col("b")))


def repeated(mers: DataFrame, least: int = 2) -> DataFrame:
    """kmer, n of canonical pairs that occur at least `least` times."""
    return mers.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def max_symbol(steps: DataFrame, value: str = "snode") -> DataFrame:
    """One row: the largest absolute value."""
    return steps.agg(F.max(F.abs(value)).alias("max_abs"))


def as_arrays(steps: DataFrame, keys: list[str], value: str = "snode") -> DataFrame:
    """keys and values: each traversal's values in order."""
    return steps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("values"))


def offsets(lengths: DataFrame, order: list[str], length: str = "len") -> DataFrame:
    """lengths with `offset`: where each traversal starts in the flat array."""
    return running_total(lengths, order, length, "offset")


def sliced(flat: DataFrame, text: str, lengths: str) -> DataFrame:
    """flat rows (a concatenated string and the parts' lengths) as idx, part."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<s:bigint,n:int>>)").alias("out"))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + 1).alias("s"), n.cast("int").alias("n")))).alias("out"))
    places = F.aggregate(F.transform(lengths, lambda n: n.cast("bigint")), start, add, lambda acc: acc["out"])
    rows = flat.select(*[c for c in flat.columns if c != lengths], F.posexplode(places).alias("idx", "_p"))
    return rows.select(*[c for c in flat.columns if c not in (text, lengths)], "idx", F.substr(F.col(text), F.col("_p.s").cast("int"), F.col("_p.n")).alias("part"))
