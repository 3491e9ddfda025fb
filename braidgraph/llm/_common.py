"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_dir, staged, unstage, work_dir  # noqa: F401  used by the operators

#: Rows of one Arrow batch sent to Python; with whole texts this keeps a worker's batch to a few MB.
BATCH_ROWS = 500


def ready(spark: SparkSession) -> None:
    """Settle the session for Python stages: the package on the workers' path, and small Arrow batches unless it has smaller ones.

    The size of batches is read when a lazy result is computed at last, so it can't be put back here; no result depends on it.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[2]
    on_path = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)] + [Path.cwd()]
    sc = spark.sparkContext
    if root not in on_path and not getattr(sc, "_braid_shipped", False):
        folder = tempfile.mkdtemp(prefix="braid-package-")  # the driver serves the archive from here while the session lasts
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/braidgraph", "zip", root, "braidgraph"))
        sc._braid_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal doc_id modulo parts; null ids are in no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def unit_hash(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: Blanks: space, and tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]"


def word_count(text: Column) -> Column:
    """Number of maximal runs without blanks; null: 0. One pass: pieces between blanks, less empty ones at the ends."""
    blank = lambda c: F.when(c.rlike(f"^{BLANKS}$"), 1).otherwise(0)
    n = F.size(F.split(text, f"{BLANKS}+", -1)) - blank(F.left(text, F.lit(1))) - blank(F.right(text, F.lit(1)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n).cast("long")
