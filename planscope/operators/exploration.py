"""Aggregates over searches: join orders, templates, cases and their benefits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_histogram(orders: DataFrame) -> DataFrame:
    """(alias, position, n): how often an alias stands at each position of the join orders (column ``order``)."""
    return orders.select(F.posexplode("order").alias("position", "alias")).groupBy("alias", "position").agg(F.count("*").alias("n"))


def leading_sets(orders: DataFrame, n: int, k: int) -> DataFrame:
    """The k most frequent sets of the first n aliases."""
    sets = orders.groupBy(F.array_sort(F.slice("order", 1, n)).alias("tables")).agg(F.count("*").alias("n"))
    return sets.orderBy(F.col("n").desc(), "tables").limit(k)


def next_steps(orders: DataFrame, prefix: list[str]) -> DataFrame:
    """(step, n): what follows a prefix, and how often: one level of the prefix trie."""
    k = len(prefix)
    rows = orders.where((F.size("order") > k) & (F.slice("order", 1, k) == F.array(*[F.lit(p) for p in prefix]) if prefix else F.size("order") > 0))
    return rows.groupBy(F.element_at("order", k + 1).alias("step")).agg(F.count("*").alias("n"))


def same_order(a: Column, b: Column, n: int) -> Column:
    """Equal as sets in the first n places and in order after them."""
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    return (F.array_sort(F.slice(a, 1, n)) == F.array_sort(F.slice(b, 1, n))) & (rest(a) == rest(b))


def summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean p-error and benefit, extremes and status counts."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("p_error").alias("mean_p_error"), F.max("p_error").alias("max_p_error"), F.min("p_error").alias("min_p_error"),
        F.percentile("p_error", F.lit(0.5)).alias("median_p_error"), F.count_if(F.col("status") == "effective").alias("effective"), F.count_if(F.col("status") == "valid").alias("valid"),
    )


def best_path(paths: DataFrame, keys: list[str], invalid: float = 10.0) -> DataFrame:
    """The largest inferred benefit per key; paths that can't be extended count as ``invalid``."""
    return paths.groupBy(*keys).agg(F.max(F.when(F.col("extendable"), F.col("benefit")).otherwise(F.lit(invalid))).alias("benefit"))


def tree_benefits(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Largest benefit of candidate nodes (-1 if none) and mean of finished ones (0 if none)."""
    return nodes.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("state") == "candidate", F.col("benefit"))), F.lit(-1.0)).alias("candidate"),
        F.coalesce(F.avg(F.when(F.col("state") == "finished", F.col("benefit"))), F.lit(0.0)).alias("finished"),
    )


def high_templates(results: DataFrame, keys: list[str], k: int, n: int, least_cases: int = 5) -> DataFrame:
    """Templates whose largest error reaches max(k-th best template, n-th best single error) and that have cases enough."""
    best = results.groupBy(*keys).agg(F.max("p_error").alias("best"), F.count("*").alias("cases"))
    kth = best.withColumn("i", F.row_number().over(Window.orderBy(F.col("best").desc()))).where(F.col("i") == k).select(F.col("best").alias("a"))
    nth = results.select("p_error").orderBy(F.col("p_error").desc()).limit(n).agg(F.min("p_error").alias("b"))
    limit = kth.join(F.broadcast(nth)).select(F.greatest("a", "b").alias("limit"))
    return best.join(F.broadcast(limit)).where((F.col("best") >= F.col("limit")) & (F.col("cases") >= least_cases)).drop("limit")


def update_errors(true: DataFrame, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """q-errors (smoothed by 1; 1 where a side is missing) of old and new estimates on common keys."""
    q = lambda e: F.coalesce(F.greatest((F.col("card") + 1.0) / (F.col(e) + 1.0), (F.col(e) + 1.0) / (F.col("card") + 1.0)), F.lit(1.0))
    return true.join(old, keys, "left").join(new, keys, "left").select(*keys, q("old").alias("q_old"), q("new").alias("q_new"))


def error_report(errors: DataFrame, bins_per_decade: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of one-sided errors above 1: (max, fifth, p90, median) and a histogram over log-spaced bins."""
    over = errors.where(F.col("error") > 1)
    fifth = over.orderBy(F.col("error").desc()).limit(5).agg(F.min("error").alias("fifth"))
    rest = over.agg(F.max("error").alias("worst"), F.percentile("error", F.lit(0.9)).alias("p90"), F.percentile("error", F.lit(0.5)).alias("median"))
    histogram = over.groupBy(F.floor(F.log10("error") * bins_per_decade).alias("bin")).agg(F.count("*").alias("n"))
    return rest.join(F.broadcast(fifth)), histogram


def one_hot(tables: Column, names: list[str]) -> Column:
    return F.array(*[F.array_contains(tables, n).cast("int") for n in names])


def grid_conditions(m: DataFrame, bins: list[int]) -> DataFrame:
    """(lower, upper, cnt): one predicate per bin with its exact count."""
    at = lambda i: F.element_at(F.array(*[F.lit(b).cast("long") for b in bins]), i.cast("int"))
    return m.select((at(F.col("bin")) + 1).alias("lower"), at(F.col("bin") + 1).alias("upper"), "cnt")
