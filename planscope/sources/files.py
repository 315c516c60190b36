"""Readers and writers: headerless CSV tables, estimator exchange files, result registries, asynchronous logs."""

from __future__ import annotations

import json
import os
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_table(spark: SparkSession, path: str, columns: list[tuple[str, str]], sep: str = ",") -> DataFrame:
    """A headerless CSV with an explicit schema; quote ``"``, escape backslash."""
    schema = ", ".join(f"`{n}` {t}" for n, t in columns)
    return spark.read.csv(path, schema=schema, sep=sep, quote='"', escape="\\", header=False)


def ingest_csv(spark: SparkSession, paths: dict[str, str], columns: dict[str, list[tuple[str, str]]], out: str, sep: str = ",") -> list[str]:
    """CSV tables to Parquet."""
    for name, path in paths.items():
        csv_table(spark, path, columns[name], sep).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return sorted(paths)


def read_json(path: str, default=None):
    """A small JSON file of the driver; the default where it doesn't exist."""
    if not os.path.exists(path):
        return {} if default is None else default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_json(path: str, value) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True)
    os.replace(f"{path}.new", path)


def write_estimator_batch(df: DataFrame, path: str) -> None:
    """(query_no, query, cardinality_true) for an external estimator."""
    df.select("query_no", "query", "cardinality_true").write.mode("overwrite").option("header", True).csv(path)


def read_estimator_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="query_no int, query string, cardinality_predict double")


def async_log(lines: DataFrame) -> DataFrame:
    """``key#query#cardinality#seconds`` lines (column value) as key, aliases, query, card, seconds, subquery. A card of -1
    timed out and is null; malformed lines go; a key with one alias is a single table."""
    parts = F.split("value", "#", 4)
    rows = lines.where(F.size(F.filter(F.split("value", "#"), lambda _: F.lit(True))) >= 4).select(
        parts[0].alias("key"), parts[1].alias("query"), F.expr("try_cast(split(value, '#', 4)[2] as bigint)").alias("c"), F.expr("try_cast(split(value, '#', 4)[3] as double)").alias("seconds")
    )
    aliases = F.array_sort(F.filter(F.split("key", r"[ ,()']+"), lambda x: x != ""))
    return rows.select("key", aliases.alias("aliases"), "query", F.when(F.col("c") >= 0, F.col("c")).alias("card"), "seconds", (F.size(aliases) > 1).alias("subquery"))


def reloptinfo(lines: DataFrame) -> DataFrame:
    """``RELOPTINFO (a b): rows=n width=w`` lines as aliases, rows, width."""
    p = r"RELOPTINFO \(([^)]*)\): rows=(\d+) width=(\d+)"
    return lines.where(F.col("value").rlike(p)).select(
        F.array_sort(F.split(F.regexp_extract("value", p, 1), " ")).alias("aliases"), F.regexp_extract("value", p, 2).cast("long").alias("rows"), F.regexp_extract("value", p, 3).cast("int").alias("width")
    )


class ResultStore:
    """Results by run id as partitioned Parquet, with a JSON registry of their configurations."""

    def __init__(self, root: str):
        self.root, self.index = root, f"{root}/registry.json"

    def save(self, results: DataFrame, config: dict, reference: int | None = None) -> int:
        """Stores a run; a configuration inherits from that of ``reference``."""
        known = read_json(self.index)
        run = max(map(int, known), default=0) + 1
        base = known.get(str(reference), {}) if reference is not None else {}
        results.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{self.root}/results")
        write_json(self.index, known | {str(run): {**base, **config}})
        return run

    def load(self, spark: SparkSession, run: int | str = "latest") -> DataFrame:
        known = read_json(self.index)
        run = max(map(int, known)) if run == "latest" else int(run)
        return spark.read.parquet(f"{self.root}/results").where(F.col("run") == run)

    def find(self, **where) -> list[int]:
        return sorted(int(k) for k, c in read_json(self.index).items() if all(c.get(x) == y for x, y in where.items()))


def configurations(options: dict[str, list]) -> list[dict]:
    """The cartesian product of option lists."""
    keys = sorted(options)
    return [dict(zip(keys, v, strict=True)) for v in product(*[options[k] for k in keys])]


CARD_SCHEMA = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("true", T.LongType()), T.StructField("est", T.LongType())])


def card_table(spark: SparkSession, cards: dict[str, dict]) -> DataFrame:
    """Card dictionaries ({true, estimation} x {subquery, single_table}) of queries as a long table."""
    rows = []
    for q, d in cards.items():
        keys = {}
        for side, name in (("true", "true"), ("estimation", "est")):
            for kind in ("subquery", "single_table"):
                for k, v in d.get(side, {}).get(kind, {}).items():
                    keys.setdefault(tuple(sorted((k,) if isinstance(k, str) else k)), {})[name] = int(v)
        rows += [(q, list(k), v.get("true"), v.get("est")) for k, v in sorted(keys.items())]
    return spark.createDataFrame(rows, CARD_SCHEMA)
