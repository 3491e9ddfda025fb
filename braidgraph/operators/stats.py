"""Counts, sizes and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packing
from ..model import PangenomeGraph


def summary(g: PangenomeGraph) -> DataFrame:
    """record, n of all kinds of records, and of steps."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("record"), "n") for name, t in g.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dense_names(segments: DataFrame) -> DataFrame:
    """n_segments, n_dense (names equal to the ordinal), share."""
    same = F.count_if(F.col("name") == F.col("node_id").cast("string"))
    return segments.agg(F.count("*").alias("n_segments"), same.alias("n_dense")).select("*", F.when(F.col("n_segments") == 0, 0.0).otherwise(F.col("n_dense") / F.col("n_segments")).alias("share"))


def column_sizes(table: DataFrame, name: str) -> DataFrame:
    """tbl, col, bytes: what each column takes as text or as plain numbers, in one pass."""
    width = {"bigint": 8, "int": 4, "double": 8, "float": 4, "timestamp": 8, "boolean": 1}
    sums = [F.coalesce(F.sum(F.octet_length(c) if t == "string" else F.when(F.col(c).isNotNull(), width.get(t, 8)).otherwise(0)), F.lit(0)).cast("bigint").alias(c) for c, t in table.dtypes if t in width or t == "string"]
    one = table.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("bytes")) for c in one.columns])).alias("x")).select(F.lit(name).alias("tbl"), "x.col", "x.bytes")


def packed_orientations(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, byte_idx, byte: eight orientation flags a byte, the first in the lowest bit."""
    bit = F.when(F.col("snode") < 0, F.expr("shiftleft(1L, cast(pos % 8 as int))")).otherwise(F.lit(0))
    return steps.groupBy(*keys, F.floor(F.col("pos") / 8).alias("byte_idx")).agg(F.sum(bit).alias("byte"))


def varint_sizes(deltas: DataFrame, keys: list[str], value: str = "snode") -> DataFrame:
    """keys, n, bytes: what zigzag and 7-bit groups would take."""
    return deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(packing.varint_bytes(packing.zigzag(F.col(value)))).cast("bigint").alias("bytes"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows that only one of two tables has, repeated rows counted."""
    cols = a.columns
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.exceptAll(b.select(*cols)), "left").unionByName(count(b.select(*cols).exceptAll(a), "right"))


def plain(df: DataFrame) -> DataFrame:
    """Maps as sorted entries, so that rows can be compared."""
    return df.select(*(F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes))


def same_graph(a: PangenomeGraph, b: PangenomeGraph, names: bool = False) -> dict[str, int]:
    """Rows in which two graphs differ, by table; segment names count only if asked for. Empty: equal."""
    out = {}
    left, right = a.tables(), b.tables()
    for name in sorted({*left, *right}):
        if name not in left or name not in right:
            out[name] = (left.get(name) or right.get(name)).count()
            continue
        drop = ["name"] if name == "segments" and not names else []
        n = differences(plain(left[name].drop(*drop)), plain(right[name].drop(*drop))).agg(F.sum("n")).first()[0]
        if n:
            out[name] = n
    return {k: v for k, v in out.items() if v}


def split_tail(lines: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(all but the last n, the last n) of lines (line_no, line)."""
    last = lines.orderBy(F.col("line_no").desc()).limit(n)
    return lines.join(last.select("line_no"), "line_no", "left_anti"), last
