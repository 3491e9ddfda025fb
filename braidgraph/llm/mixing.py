"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and `cap`, entropy balancing takes those that give every source its target number of
words and are closest to 1 in relative entropy. They are exponential tilts, rate = min(cap, exp(lambda * size / ref)),
with one multiplier per source. The convex dual falls apart by source: each source's Newton iterations run over its
counts of documents by size, in a task of its own, all sources at a time. Rates are then rounded to whole copies so that
the words taken stay within about half a short document of the target, however the sizes are spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged, unstage, word_count

#: A hot (source, size) is split into so many parts, by ranges of its rows' keys, before rows are ranked.
PARTS = 64
SRC = ["_s", "_n"]  # the source, and whether it is null
#: Up to so many decisions (a source and a size each, some 100 bytes) are sent to all tasks; more of them meet the rows by an exchange.
SENT = 500_000


def ranked(df: DataFrame, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for each of sums, the total over all earlier rows in the order: ranges are sorted and summed on their own,
    and one total a range reaches the driver."""
    wide = df.select("*", *(c.alias(f"_v{n}") for n, c in sums.items()))
    held = staged(wide.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_r")), name)
    before, starts = dict.fromkeys(sums, 0), {n: [] for n in sums}
    for row in held.groupBy("_p").agg(*(F.sum(f"_v{n}").alias(n) for n in sums)).orderBy("_p").collect():
        for n in sums:
            starts[n] += [F.lit(row["_p"]), F.lit(before[n])]
            before[n] += row[n]
    earlier = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    out = held
    for n in sums:
        first = F.create_map(*starts[n])[F.col("_p")] if starts[n] else F.lit(0)
        out = out.withColumn(n, first + F.coalesce(F.sum(f"_v{n}").over(earlier), F.lit(0)))
    return out.drop("_p", "_r", *(f"_v{n}" for n in sums))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """_s, _n, source_size, target: shares of all words by repeating weights in code point order of the sources, null last.

    No target exceeds cap times its source's size; what is above goes to the others by weight until none is above. The
    words a unit of weight gets at the end follow in one pass: sources stop in the order of cap * size / weight, and the
    level is what is left by the first that doesn't stop, divided by the weights from there on.
    """
    placed = ranked(sources, ["_n", "_s"], {"_rank": F.lit(1)}, "sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    table = placed.select(*SRC, "source_size", w.alias("_w"), (F.col("source_size") * cap / w).alias("_stop"))
    table = ranked(table, ["_stop", "_n", "_s"], {"_gone": F.col("source_size").cast("double") * cap, "_done": F.col("_w")}, "stops")
    total, weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    level = (F.lit(float(total)) - F.col("_gone")) / (F.lit(float(weight)) - F.col("_done"))
    last = table.select(level.alias("_level"), "_stop", *SRC).where("_level <= _stop * (1 + 1e-12)").agg(F.min_by("_level", F.struct("_stop", "_n", "_s"))).first()[0]
    most = F.col("source_size") * cap
    return table.select(*SRC, "source_size", (most if last is None else F.least(F.col("_w") * last, most)).alias("target"))


def multiplier(size: np.ndarray, n: np.ndarray, target: float, cap: float, close: float = 1e-12) -> tuple[float, float]:
    """(lambda, ref) of one source: Newton steps on its dual within bounds that close in until they meet; every fourth step halves.

    size: distinct sizes above 0, n: documents of each.
    """
    words = n * size
    ref, all_ = float((words * size).sum() / words.sum()), float(words.sum())
    x = size / ref
    if target >= all_ * cap * (1 - 1e-12):
        return math.inf, ref
    # at the lower end all rates are at most target / size, at the upper end all are at the cap
    low = min(0.0, math.log(target / all_) / float(x.min()))
    high = max(0.0, math.log(cap) / float(x.min())) if target >= all_ else 0.0
    lam, turn = 0.0, 0
    while True:
        with np.errstate(over="ignore"):
            tilt = np.exp(np.minimum(lam * x, 700.0))
        gap = float((words * np.minimum(tilt, cap)).sum()) - target
        if abs(gap) <= close * target:
            return lam, ref
        low, high = (low, lam) if gap > 0 else (lam, high)
        slope = float((words * x * tilt)[tilt < cap].sum())
        step = lam - gap / slope if slope > 0 else low
        turn += 1
        step = step if low < step < high and turn % 4 else (low + high) / 2
        if step in (low, high, lam):  # no number lies between
            return lam, ref
        lam = step


def rates(size: np.ndarray, n: np.ndarray, target: float, cap: float) -> np.ndarray:
    """The rate of each size: 1 for size 0, else min(cap, exp(lambda * size / ref)); 0 where nothing is to be taken."""
    out, some = np.ones(len(size)), size > 0
    if some.any():
        if target <= 0:
            out[some] = 0.0
        else:
            lam, ref = multiplier(size[some].astype(float), n[some].astype(float), target, cap)
            out[some] = cap if lam == math.inf else np.minimum(cap, np.exp(np.minimum(lam * size[some] / ref, 700.0)))
    return out


def rounded(size: np.ndarray, n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """How many of the n documents of each size get one copy more than the whole part of its rate.

    Goes through the sizes from large to small and carries what is short or over in words.
    """
    carry, out = 0.0, np.zeros(len(size), np.int64)
    for i in np.argsort(-size, kind="stable").tolist():
        s, m = int(size[i]), int(n[i])
        part = m * (rate[i] - int(rate[i]))
        if s and part > 1e-9:
            out[i] = min(m, max(0, round(part + carry / s)))
        carry += (part - out[i]) * s
    return out


def solved(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """_s, _n, size, n, source_size, target, _rate, _extra of cells (_s, _n, size, n).

    A task holds one source's distinct sizes, which the longest text bounds, not its documents.
    """

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("size", ignore_index=True)
        size, n = g["size"].to_numpy(), g["n"].to_numpy()
        rate = rates(size, n, float(g["target"].iloc[0]), cap)
        return g.assign(_rate=rate, _extra=rounded(size, n, rate))

    both = cells.join(targets, SRC).select(*SRC, "size", "n", "source_size", "target")
    return both.groupBy(*SRC).applyInPandas(solve, "_s string, _n boolean, size long, n long, source_size long, target double, _rate double, _extra long")


def part_of(key: Column) -> Column:
    """Which of PARTS equal ranges a 64-bit key lies in."""
    return (F.shiftright(key, 64 - (PARTS.bit_length() - 1)) + PARTS // 2).cast("int")


def decided(rows: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """A row for each cell of rows (_s, _n, size, _k): size, rate, targets, and whose keys get the extra copy.

    Documents of a cell get it in the order of their keys: all below _edge, and _some of the _tied that have just this
    key. Only the part of a cell's keys in which the edge lies is ranked.
    """
    parts = staged(rows.groupBy(*SRC, "size", part_of(F.col("_k")).alias("_part")).agg(F.count("*").alias("n")), "parts")
    cells = staged(parts.groupBy(*SRC, "size").agg(F.sum("n").alias("n")), "cells")
    targets = source_targets(cells.groupBy(*SRC).agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    plan = staged(solved(cells, targets, cap), "plan")
    upto = F.sum("n").over(Window.partitionBy(*SRC, "size").orderBy("_part"))  # at most PARTS rows a window
    edge = parts.withColumn("_to", upto).join(plan.where("_extra > 0").select(*SRC, "size", "_extra"), [*SRC, "size"])
    edge = edge.where("_to >= _extra and _to - n < _extra").select(*SRC, "size", "_part", (F.col("_extra") - F.col("_to") + F.col("n")).alias("_want"))
    keys = rows.withColumn("_part", part_of(F.col("_k"))).join(edge, [*SRC, "size", "_part"]).groupBy(*SRC, "size", "_want", "_k").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*SRC, "size").orderBy("_k"))
    edge = keys.withColumn("_to", upto).where("_to >= _want and _to - _m < _want").select(*SRC, "size", F.col("_k").alias("_edge"), F.col("_m").alias("_tied"), (F.col("_want") - F.col("_to") + F.col("_m")).alias("_some"))
    out = staged(plan.join(edge, [*SRC, "size"], "left").drop("n", "_extra"), "decided")
    unstage(parts, cells, plan)
    return out


def with_copies(rows: DataFrame, source: str, size: str, key: list[str], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """rows as the struct `row`, with size, source_size, target, rate, copies.

    key: columns that order rows of one source and size repeatably, by hash. Sizes must not be null. Whole rows are not
    sorted: decisions are made on sizes and keys, and rows meet the table of decisions, one line for each source and size;
    it is sent to the rows if its counted lines are few enough, however many rows there are.
    """
    src = F.col(source).cast("string")
    base = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.coalesce(src, F.lit("")).alias("_s"), src.isNull().alias("_n"),
        F.col(size).alias("size"), F.xxhash64(*key).alias("_k"),
    )
    table = decided(staged(base.drop("row"), "keys"), weights, cap)
    joined = base.join(F.broadcast(table) if table.count() <= SENT else table, [*SRC, "size"])
    extra = F.when(F.col("_k") < F.col("_edge"), 1).when((F.col("_k") == F.col("_edge")) & (F.col("_some") == F.col("_tied")), 1).otherwise(0)
    copies = F.floor("_rate") + F.coalesce(extra, F.lit(0))
    shown = lambda df, c: df.select("row", "size", "source_size", "target", F.col("_rate").alias("rate"), c.cast("int").alias("copies"))
    torn = (F.col("_k") == F.col("_edge")) & (F.col("_some") < F.col("_tied"))
    if not table.where("_some < _tied").limit(1).count():
        return shown(joined, copies)
    # rows with one key of which only some get the copy: any of them, by place
    place = F.row_number().over(Window.partitionBy(*SRC, "size").orderBy(F.lit(0)))
    some = joined.where(torn).withColumn("_place", place)
    return shown(joined.where(~F.coalesce(torn, F.lit(False))), copies).unionByName(shown(some, F.floor("_rate") + F.when(F.col("_place") <= F.col("_some"), 1).otherwise(0)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies of every document.

    Null and empty texts have size 0, rate 1, one copy, and take nothing; a null source is a source of its own; very long
    texts are documents like others. Documents of equal source and size are ordered by a hash of doc_id; rows with equal
    doc_id by place only, so any of them may get the extra copy. All rows come back, repeated ones too. An empty table
    gives an empty result; extra columns are ignored.
    """
    # the texts are read once: what follows works on three narrow columns
    rows = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = with_copies(rows, "source", "size", ["doc_id"], weights, cap)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", "copies")


def repeated(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: sources near their targets.

    Null and empty texts stay once; null sources, ties, repeated rows and long texts as in mix(). All columns come back,
    whatever their names; no rows give no rows.
    """
    size = "_size"
    while size in docs.columns:
        size += "_"
    rows = docs.withColumn(size, word_count(F.col("text")))
    out = with_copies(rows, "source", size, ["doc_id"], weights, cap).where("copies > 0")
    row = F.explode(F.array_repeat("row", F.col("copies")))
    return out.select(row.alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
