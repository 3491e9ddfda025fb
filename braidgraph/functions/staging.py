"""Cutting lineage, and global numbering without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see. Where it is unset, a temporary folder on a local master, else an error:
    the executors of a cluster would write to disks of their own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(sc, "_braid_shared", None)
        if base is None:
            base = sc._braid_shared = tempfile.mkdtemp(prefix="braid-shared-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder of this application under shared_dir(), removed when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/braid/{sc.applicationId}"
    if getattr(sc, "_braid_work", None) != path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        sc._braid_work = path
    return path


_open = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end what staged() wrote within it: for work whose result is written elsewhere."""
    outer, _open.frames = getattr(_open, "frames", None), []
    try:
        yield
    finally:
        frames, _open.frames = _open.frames, outer
        unstage(*frames)


#: Spark's switch for removing an execution's shuffle files at its end; by itself that waits for the driver's garbage collection.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files: for steps whose results are staged or counted."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def staged(df: DataFrame, name: str = "part", compression: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: survives the loss of executors, unlike a cache."""
    path = f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._braid_path = path
    if getattr(_open, "frames", None) is not None:
        _open.frames.append(out)
    return out


def unstage(*frames: DataFrame) -> None:
    """Remove what staged() wrote, once nothing will read it again; what is never unstaged goes with the application."""
    for df in frames:
        path = getattr(df, "_braid_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Numbers of a table that are sent to all tasks in packs of PACK, and rows that are sent as they are.
FEW, PACK, ROWS = 1_500_000, 1_024, 200_000


def few(df: DataFrame, *otherwise: DataFrame | None) -> DataFrame | None:
    """df, to be sent to all tasks if it has at most ROWS rows, else as it is (or what is given for that case).

    For rows of a few numbers, so that the larger side of a join stays where it is. The driver holds what is sent several
    times over, some hundred bytes a row; see Lookup for more rows.
    """
    if df.count() <= min(FEW, ROWS):
        return F.broadcast(df)
    return otherwise[0] if otherwise else df


@dataclass(frozen=True)
class Lookup:
    """A value for each of some keys, the last of which is a whole number, to be joined to a larger side that stays where it is.

    Above ROWS rows the table is packed: one row has the values of PACK numbers in succession, with gaps where there are none,
    so that the driver collects and sends arrays, nine bytes a number. Beyond FEW numbers (gaps count), or where keys
    repeat, it is joined as it is.
    """

    table: DataFrame
    keys: list[str]
    value: str
    packed: bool = False

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], value: str) -> Lookup:
        df = df.select(*keys, value)
        n = df.count()
        if n <= min(FEW, ROWS):
            return cls(F.broadcast(df), keys, value)
        if n > FEW:
            return cls(df, keys, value)
        *rest, last = keys
        at = df.where(F.col(last).isNotNull()).select(*rest, *in_pack(F.col(last)), value)
        with freed(df.sparkSession):
            each = at.groupBy(*rest, "_pack").agg(F.count("*").alias("n"), F.size(F.collect_set("_place")).alias("k"))
            packs, rows, different = each.agg(F.count("*"), F.sum("n"), F.sum("k")).first()
            if packs * PACK > FEW + PACK or rows != different:  # sparse or repeated; the last pack need not be full
                return cls(df, keys, value)
            cells = F.array_sort(F.collect_list(F.struct("_place", F.struct(value).alias("_cell"))))
            none = F.lit(None).cast(f"struct<`{value}`:{df.schema[value].dataType.simpleString()}>")
            before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("_cells"), i - 1)["_place"])
            gaps = F.flatten(F.transform("_cells", lambda c, i: F.concat(F.array_repeat(none, c["_place"] - before(i) - 1), F.array(c["_cell"]))))
            filled = at.groupBy(*rest, "_pack").agg(cells.alias("_cells")).select(*rest, "_pack", gaps.alias("_filled"))
            arrays = (F.transform("_filled", lambda c: c.isNotNull()).alias("_there"), F.transform("_filled", lambda c: c[value]).alias("_values"))
            return cls(staged(filled.select(*rest, "_pack", *arrays), "packed", "zstd"), keys, value, True)

    def join(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """rows (with the keys) and their value; how: inner, or left for a null where there is none."""
        if not self.packed:
            return rows.join(self.table, self.keys, how)
        *rest, last = self.keys
        pack, place = in_pack(F.col(last))
        table = self.table.select(*(F.col(c).alias(f"_{c}") for c in rest), F.col("_pack").alias("_of"), "_there", "_values")
        on = pack == F.col("_of")
        for c in rest:
            on &= F.col(c) == F.col(f"_{c}")
        both = rows.join(F.broadcast(table), on, how)
        if how == "inner":
            both = both.where(F.get("_there", place))
        return both.select(*rows.columns, F.get("_values", place).alias(self.value))


def in_pack(key: Column) -> tuple[Column, Column]:
    """_pack, _place of a whole number."""
    key = key.cast("bigint")
    return F.shiftright(key, PACK.bit_length() - 1).alias("_pack"), key.bitwiseAND(F.lit(PACK - 1)).cast("int").alias("_place")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with a dense number by the order of the given columns.

    Rows are sorted by ranges, counted by range, and numbered from the counts: no task sees all rows. Only one count
    per partition reaches the driver.
    """
    held = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_r")), "numbered")
    before, starts = start, []
    for p, n in sorted((r["_p"], r["n"]) for r in held.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        starts += [F.lit(p), F.lit(before)]
        before += n
    first = F.create_map(*starts)[F.col("_p")] if starts else F.lit(start)
    return held.withColumn(name, (first + F.col("_r")).cast("long")).drop("_p", "_r")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over all earlier rows (exclusive), computed range by range."""
    held = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_r")), "totals")
    before, starts = 0, []
    for p, n in sorted((r["_p"], r["n"]) for r in held.groupBy("_p").agg(F.sum(value).alias("n")).collect()):
        starts += [F.lit(p), F.lit(before)]
        before += n or 0
    own = F.sum(value).over(Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    first = F.create_map(*starts)[F.col("_p")] if starts else F.lit(0)
    return held.withColumn(name, (first + F.coalesce(own, F.lit(0))).cast("long")).drop("_p", "_r")
