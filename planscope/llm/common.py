"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts are large: the queries and stages ask for Arrow batches of ``BATCH_ROWS`` rows, so that
    neither the JVM nor a Python worker holds tens of MB of texts at once. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for reliable checkpoints and intermediate tables that all executors share: the cluster names it in
    spark.checkpoint.dir. Without it a folder of our own serves a local master only; a cluster without one is an error,
    as executors would not find each other's files."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "planscope-checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def text_slices(column, rows: int = 256) -> Iterator[list]:
    """The values of an Arrow column, a few hundred at a time, so that a large batch isn't held twice."""
    for lo in range(0, len(column), rows):
        yield column.slice(lo, rows).to_pylist()


def release_memory() -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive tasks and stages."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
