"""Cardinality tables of the sub-joins of queries, and their completion.

A card table is long: query_id, aliases (sorted array), and nullable ``true`` and ``est`` (bigint or double). A key with one
alias is a single table. The lattice of a query is the containment order of its connected alias sets; it has at most
2**tables rows, so joins by containment run within a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planscope.catalog import Catalog

#: Rows of a table that one task sorts, whatever the table's size (84 MB of memory, measured).
ROWS_A_TASK = 500_000


def lattice(spark: SparkSession, catalog: Catalog, tables: list[str], query_id: str = "q", least: int = 1) -> DataFrame:
    rows = [(query_id, list(s)) for s in catalog.sub_joins(tables, least)]
    return spark.createDataFrame(rows, "query_id string, aliases array<string>")


def contained(sub: Column, sup: Column) -> Column:
    return F.size(F.array_except(sub, sup)) == 0


def containment(cards: DataFrame) -> DataFrame:
    """(query_id, sub, sup) with sub a proper subset of sup."""
    a = cards.select("query_id", F.col("aliases").alias("sub"))
    b = cards.select("query_id", F.col("aliases").alias("sup"))
    return a.join(b, "query_id").where(contained(F.col("sub"), F.col("sup")) & (F.size("sub") < F.size("sup")))


def edges(cards: DataFrame) -> DataFrame:
    """Containments by one table, with the table that is added."""
    return containment(cards).where(F.size("sup") == F.size("sub") + 1).withColumn("added", F.get(F.array_except("sup", "sub"), F.lit(0)))


def missing(expected: DataFrame, cards: DataFrame, side: str = "true") -> DataFrame:
    """Expected (query_id, aliases) without a value on that side."""
    return expected.join(cards.where(F.col(side).isNotNull()).select("query_id", "aliases"), ["query_id", "aliases"], "left_anti")


def valid(cards: DataFrame) -> DataFrame:
    """(query_id, valid): all values are there and none is negative."""
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) >= -1e-6)
    return cards.groupBy("query_id").agg(F.bool_and(ok("true") & ok("est")).alias("valid"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two card tables; values of ``new`` win."""
    both = old.alias("o").join(new.alias("n"), ["query_id", "aliases"], "full")
    return both.select("query_id", "aliases", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("true", "est")])


def ratio_completed(cards: DataFrame) -> DataFrame:
    """Missing true values from the largest known subset: true(sub) * est(q) / est(sub); ties by its aliases."""
    known = cards.where(F.col("true").isNotNull()).select("query_id", F.col("aliases").alias("sub"), F.col("true").alias("t"), F.col("est").alias("e"))
    open_ = cards.where(F.col("true").isNull()).select("query_id", "aliases", "est")
    pairs = open_.join(known, "query_id").where(contained(F.col("sub"), F.col("aliases")))
    w = Window.partitionBy("query_id", "aliases").orderBy(F.size("sub").desc(), F.array_join("sub", ","))
    best = pairs.withColumn("n", F.row_number().over(w)).where("n = 1")
    filled = best.select("query_id", "aliases", F.try_divide(F.col("t").cast("double") * F.col("est"), F.col("e").cast("double")).alias("inferred"))
    return cards.join(filled, ["query_id", "aliases"], "left").withColumn("inferred", F.coalesce(F.col("true").cast("double"), "inferred", F.col("est").cast("double")))


def neighbour_completed(cards: DataFrame) -> DataFrame:
    """Missing true values as est times the mean of (10 + true) / (10 + est) over the known subsets one table smaller."""
    near = edges(cards).join(cards.where(F.col("true").isNotNull()).select("query_id", F.col("aliases").alias("sub"), "true", "est"), ["query_id", "sub"])
    rate = near.groupBy("query_id", F.col("sup").alias("aliases")).agg(F.avg((10.0 + F.col("true")) / (10.0 + F.col("est"))).alias("rate"))
    out = cards.join(rate, ["query_id", "aliases"], "left")
    return out.withColumn("inferred", F.coalesce(F.col("true").cast("double"), F.col("est") * F.coalesce("rate", F.lit(1.0)))).drop("rate")


def case_scaled(cards: DataFrame, factors: DataFrame) -> DataFrame:
    """A stored case reused: sub-joins that touch a changed table are scaled by its factor (query_id, alias, factor)."""
    touched = cards.join(factors, "query_id").where(F.array_contains("aliases", F.col("alias")))
    product = touched.groupBy("query_id", "aliases").agg(F.exp(F.sum(F.log("factor"))).alias("f"))
    out = cards.join(product, ["query_id", "aliases"], "left")
    return out.withColumn("inferred", F.col("true") * F.coalesce("f", F.lit(1.0))).drop("f")


def scale_candidates(value: Column, n: int, low: float = 0.5, high: float = 2.0, kind: str = "ratio") -> Column:
    """n candidate values between low and high times the value, evenly spaced ("difference") or by equal ratios."""
    i = F.sequence(F.lit(0), F.lit(n - 1))
    if kind == "difference":
        return F.transform(i, lambda k: value * (F.lit(low) + (high - low) * k / F.lit(max(1, n - 1))))
    return F.transform(i, lambda k: value * F.lit(low) * F.pow(F.lit(high / low), k / F.lit(max(1, n - 1))))


def log_distance(a: DataFrame, b: DataFrame, side: str = "true") -> DataFrame:
    """(query_id, distance): sum of |ln((a + 1000) / (b + 1000))| over common keys."""
    both = a.select("query_id", "aliases", F.col(side).alias("x")).join(b.select("query_id", "aliases", F.col(side).alias("y")), ["query_id", "aliases"])
    return both.groupBy("query_id").agg(F.sum(F.abs(F.log((F.col("x") + 1000.0) / (F.col("y") + 1000.0)))).alias("distance"))


def log_ratio_pairs(df: DataFrame) -> DataFrame:
    """Pairs of queries over the same tables with ln((card_a + 1) / (card_b + 1)), neighbours by query_id: a chain per
    table set, from which every other pair's label is a sum."""
    w = Window.partitionBy("tables").orderBy("query_id")
    rows = df.withColumn("b", F.lead("query_id").over(w)).withColumn("card_b", F.lead("card").over(w)).where("b is not null")
    return rows.select("tables", F.col("query_id").alias("a"), "b", F.log((F.col("card") + 1.0) / (F.col("card_b") + 1.0)).alias("label"))


def transferred(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Predicate transfer: for each asked range (query_id, column, lo, hi, marginal) the card of the nearest known
    range of its column, scaled by the ratio of the marginals. Of equally near ones the first by lo and hi counts; a range
    without a distance comes last. A query that asks for several ranges gets the nearest of all.

    The known ranges are broadcast, so that no row moves by its column: each asked row picks from the list of its column.
    Rows are then dealt by query in so many parts that a task holds about ``ROWS_A_TASK``, which counts the asked rows when
    called. Before that they are dealt by query and a hash of origin and values, so that a query with very many ranges isn't one task."""
    order = [F.col(c).asc_nulls_last() for c in ("lo", "hi", "marginal", "card", "column")]
    placed = known.where("column is not null").withColumn("place", F.row_number().over(Window.orderBy(*order)))
    lists = placed.groupBy("column").agg(F.collect_list(F.struct("place", "lo", "hi", "marginal", "card")).alias("known"))

    def candidate(k: Column) -> Column:
        near = F.abs(F.col("lo") - k["lo"]) + F.abs(F.col("hi") - k["hi"])
        return F.struct(near.isNull().alias("last"), near.alias("near"), k["place"].alias("place"), k["card"].alias("card"), k["marginal"].alias("km"))

    parts = max(1, -(-asked.count() // ROWS_A_TASK))
    ranges = asked.select("query_id", "column", "lo", "hi", "marginal")
    best = ranges.join(F.broadcast(lists), "column").select("query_id", "marginal", F.array_min(F.transform("known", candidate)).alias("b"))
    estimate = F.col("b.card") * F.try_divide(F.col("marginal").cast("double"), F.col("b.km").cast("double"))
    rows = best.select("query_id", "b.near", "b.place", estimate.alias("estimate"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64(F.spark_partition_id(), "near", "place", "estimate"), F.lit(parts)))
    nearest = F.min(F.struct(F.isnull("near"), "near", "place", "estimate")).alias("b")
    some = rows.repartition(parts, "query_id", "share").groupBy("query_id", "share").agg(nearest).select("query_id", "b.near", "b.place", "b.estimate")
    return some.repartition(parts, "query_id").groupBy("query_id").agg(nearest).select("query_id", "b.estimate")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that both card tables hold with equal values (two nulls are equal)."""
    columns = ["query_id", "aliases", "true", "est"]
    return a.select(*columns).intersect(b.select(*columns))
