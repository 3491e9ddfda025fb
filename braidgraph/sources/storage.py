"""A graph as a folder of Parquet tables (Zstd), with or without a rulebook."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, PangenomeGraph
from ..operators import grammar

FORMAT, VERSION = "braidgraph", 1


class BadContainer(ValueError):
    """A folder that is no stored graph of this version."""


def zstd(table: DataFrame, level: int) -> DataFrameWriter:
    return table.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))


def save(g: PangenomeGraph, path: str, rounds: int = 0, delta: int = 1, level: int = 9, least: int = 2) -> None:
    """Write all tables; with rounds > 0 the steps are stored coded, with their rules.

    Steps are sorted by traversal, so that readers of a few traversals skip most row groups. level: of Zstd, 1 to 22.
    least: how often a pair must occur to get a rule.
    """
    if not 1 <= level <= 22:
        raise ValueError("Zstd level outside 1..22")
    spark = g.segments.sparkSession
    spark.createDataFrame([(FORMAT, VERSION, rounds, delta)], "format string, version int, rounds int, delta int").coalesce(1).write.json(f"{path}/_about")
    for name, table in g.tables().items():
        if name == "steps" and rounds:
            coded, rules = grammar.encode(table, ["kind", "trav"], rounds, delta, least)
            zstd(rules, level).parquet(f"{path}/rules")
            table = coded
        if name == "steps":
            table = table.repartitionByRange("kind", "trav", "pos").sortWithinPartitions("kind", "trav", "pos")
        zstd(table, level).parquet(f"{path}/{name}")


def about(spark: SparkSession, path: str) -> dict:
    got = spark.read.schema("format string, version int, rounds int, delta int").json(f"{path}/_about").first()
    if got is None or (got["format"], got["version"]) != (FORMAT, VERSION):
        raise BadContainer(path)
    return got.asDict()


def load(spark: SparkSession, path: str, tables: list[str] | None = None, decoded: bool = True) -> PangenomeGraph:
    """The stored graph; steps come decoded unless asked otherwise."""
    what = about(spark, path)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for name, schema in SCHEMAS.items():
        if (tables is None or name in tables or name in ("segments", "steps")) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            found[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
    if what["rounds"] and decoded:
        found["steps"] = grammar.decode(found["steps"], ["kind", "trav"], rules(spark, path), what["delta"])
    return PangenomeGraph(**found)


def rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rule_id bigint, kmer bigint, first bigint, second bigint, round int").parquet(f"{path}/rules").orderBy(F.col("rule_id"))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files that a path or pattern names, folders with all that they hold."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(where) or [])


def column_bytes(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """Table, column, bytes stored and bytes before Zstd of a store, summed from the footers of its files.

    Only footers are read, one after the other by the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs, reader = root.getFileSystem(conf), jvm.org.apache.parquet.hadoop.ParquetFileReader
    total: dict[tuple[str, str], list[int]] = {}
    for name in [*SCHEMAS, "rules"]:
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/*.parquet")) or []:
            source = reader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
            try:
                for block in source.getFooter().getBlocks():
                    for chunk in block.getColumns():
                        at = total.setdefault((name, chunk.getPath().toDotString()), [0, 0])
                        at[0] += chunk.getTotalSize()
                        at[1] += chunk.getTotalUncompressedSize()
            finally:
                source.close()
    return [(*k, *v) for k, v in total.items()]
