"""New haplotypes as a stream: files of paths that arrive in a folder are appended to a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def step_stream(spark: SparkSession, folder: str) -> DataFrame:
    """name, pos, snode of all path lines that arrive in folder."""
    lines = spark.readStream.text(folder).where("value like 'P%'")
    f = F.split(F.regexp_replace("value", "\r+$", ""), "[ \t]+")
    steps = lines.select(f[1].alias("name"), F.posexplode(F.split(f[2], ",")).alias("pos", "tok"))
    node = F.expr("try_cast(substr(tok, 1, length(tok) - 1) as bigint)")
    return steps.select("name", F.col("pos").cast("bigint").alias("pos"), F.when(F.right("tok", F.lit(1)) == "-", -node).otherwise(node).alias("snode")).where("snode is not null")


def append_stream(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append arriving paths to the Parquet folder `table`, each batch once; names that are stored already are left out."""

    def add(batch: DataFrame, batch_id: int) -> None:
        try:
            known = batch.sparkSession.read.parquet(table).select("name").distinct()
            batch = batch.join(known, "name", "left_anti")
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.write.mode("append").parquet(table)

    return step_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def live_coverage(steps: DataFrame) -> DataFrame:
    """node_id, n: how many steps have visited each node so far; for output mode 'complete' or 'update'."""
    return steps.groupBy(F.abs("snode").alias("node_id")).agg(F.count("*").alias("n"))
