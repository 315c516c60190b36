"""Result streams: windows over elapsed time, late and repeated results, and completion per task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_results(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New files of a growing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 day", delay: str | None = None, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and maxima per tumbling window; the same for batches and streams (which need a ``delay`` to close windows)."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if delay:
        rows = rows.withWatermark("__ts", delay)
    out = rows.groupBy(F.window("__ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(value).alias("max_value"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "max_value")


def without_repeats(results: DataFrame, key: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Each key once within the delay; late results are dropped."""
    return results.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def merge_into(path: str, key: list[str], order: str):
    """A foreachBatch sink that keeps the newest row of each key in versioned Parquet folders: a batch writes the next
    version, so a repeated batch writes the same one."""

    def merge(batch: DataFrame, epoch: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{epoch - 1}") if epoch else None
        rows = batch if old is None else old.unionByName(batch)
        w = Window.partitionBy(*key).orderBy(F.col(order).desc())
        rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return merge


def completed_tasks(results: DataFrame, expected: int, timeout_ms: int = 60_000) -> DataFrame:
    """(task, done, received, total): a row when a task has all its ``expected`` sub-joins, or with done = false when it
    was silent too long. ``results``: task string, key string, card long (-1: timed out)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = dict(zip(*state.get, strict=True)) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task": [key[0]], "done": [False], "received": [len(got)], "total": [sum(v for v in got.values() if v >= 0)]})
            return
        for b in batches:
            got |= dict(zip(b["key"], (int(x) for x in b["card"]), strict=True))
        if len(got) >= expected:
            state.remove()
            yield pd.DataFrame({"task": [key[0]], "done": [True], "received": [len(got)], "total": [sum(v for v in got.values() if v >= 0)]})
        else:
            state.update((list(got), list(got.values())))
            state.setTimeoutDuration(timeout_ms)

    return results.groupBy("task").applyInPandasWithState(
        step, "task string, done boolean, received long, total long", "keys array<string>, cards array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
