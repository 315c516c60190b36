"""Reports over result tables: per-method, per-template and per-time aggregates, rankings and selections.

A result table has a row per evaluated query: method, query_id, p_error, cost_actual, cost_expected, elapsed, and where
needed tables and columns (arrays). Rankings use ``row_number() <= k``, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planscope.functions.metrics import METRICS, over_error, under_error


def metric_table(results: DataFrame, keys: list[str], metrics: dict | None = None, column: str = "p_error") -> DataFrame:
    return results.groupBy(*keys).agg(*[f(F.col(column)).alias(n) for n, f in (metrics or METRICS).items()])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def element_at_rank(results: DataFrame, keys: list[str], k: int, column: str = "p_error") -> DataFrame:
    """Per group the element at index k of the descending order, the least one if there are no more than k."""
    best = top_k(results.where(F.col(column).isNotNull()), keys, [F.col(column).desc()], k + 1)
    return best.groupBy(*keys).agg(F.min(column).alias("topk"))


def dedup_best(results: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_k(results, key, order, 1).drop("rank")


def cumulative_error(results: DataFrame, threshold: float, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Per method: with queries by actual / (expected + 1.1), largest first, the ratio of summed costs over those needed
    until the expected costs reach the threshold."""
    order = Window.partitionBy(*keys).orderBy((F.col("cost_actual") / (F.col("cost_expected") + 1.1)).desc(), "query_id")
    before = F.coalesce(F.sum("cost_expected").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    used = results.withColumn("__before", before).where(F.col("__before") < threshold)
    return used.groupBy(*keys).agg((F.sum("cost_actual") / F.sum("cost_expected")).alias("cumulative"))


def notable(results: DataFrame, theta: float, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """How many errors exceed ``theta``; up to 1 it is the quantile of all errors."""
    if theta <= 1:
        limit = results.agg(F.percentile("p_error", F.lit(theta)).alias("__theta"))
        results = results.join(F.broadcast(limit))
        return results.groupBy(*keys).agg(F.count_if(F.col("p_error") > F.col("__theta")).alias("notable"))
    return results.groupBy(*keys).agg(F.count_if(F.col("p_error") > theta).alias("notable"))


def template_key(tables: Column, columns: Column) -> tuple[Column, Column]:
    return F.array_sort(tables).alias("tables"), F.array_sort(columns).alias("columns")


def template_stats(results: DataFrame) -> DataFrame:
    t, c = template_key(F.col("tables"), F.col("columns"))
    return metric_table(results.select(t, c, "p_error"), ["tables", "columns"], {n: METRICS[n] for n in ("max_p_error", "p90_p_error", "p75_p_error", "median_p_error")})


def time_buckets(results: DataFrame, seconds: int, last: float | None = None, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Aggregates per method and bucket of elapsed time; times from ``last`` on count in the last bucket."""
    bucket = F.floor(F.col("elapsed") / seconds)
    if last is not None:
        bucket = F.least(bucket, F.lit(int(last // seconds)))
    return results.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("p_error").alias("max_p_error"), F.percentile("p_error", F.lit(0.5)).alias("median_p_error"))


def slope(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"))


def through_origin(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Least squares without intercept: time per unit of cost."""
    return df.groupBy(*keys).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("rate"))


def fit_quality(df: DataFrame, true: str, est: str) -> DataFrame:
    """R2 and MAPE of ln(1 + x)."""
    t, e = F.log1p(F.col(true).cast("double")), F.log1p(F.col(est).cast("double"))
    rows = df.select(t.alias("t"), e.alias("e"))
    sums = rows.agg(
        F.sum((F.col("t") - F.col("e")) * (F.col("t") - F.col("e"))).alias("res"), F.var_pop("t").alias("var"), F.count("*").alias("n"),
        F.avg(F.abs(F.try_divide(F.col("t") - F.col("e"), F.col("t")))).alias("mape"),
    )
    return sums.select((1 - F.try_divide(F.col("res"), F.col("var") * F.col("n"))).alias("r2"), "mape")


def improvement(results: DataFrame, keys: list[str], recent: int = 5) -> DataFrame:
    """The best of the last ``recent`` errors less the best before, at least 1 (all but 1 if there is none before)."""
    w = Window.partitionBy(*keys).orderBy(F.col("elapsed").desc(), F.col("query_id").desc())
    rows = results.withColumn("__n", F.row_number().over(w))
    late, early = F.max(F.when(F.col("__n") <= recent, F.col("p_error"))), F.max(F.when(F.col("__n") > recent, F.col("p_error")))
    return rows.groupBy(*keys).agg(F.greatest(F.when(early.isNull(), late - 1).otherwise(late - early), F.lit(1.0)).alias("improvement"))


def mixed_split(over: DataFrame, under: DataFrame, n: int) -> DataFrame:
    """How many of n templates to take from either ranked list so that the marginal scores are closest."""
    a = over.select(F.col("rank").alias("i"), F.col("score").alias("x"))
    b = under.select((F.lit(n) - F.col("rank")).alias("i"), F.col("score").alias("y"))
    return a.join(b, "i").agg(F.min_by("i", F.struct(F.abs(F.col("x") - F.col("y")), "i")).alias("from_over"))


def subsumed(metas: DataFrame) -> DataFrame:
    """query_ids whose set of parts (tables and filters as strings) is contained in that of another query; of equal sets
    the least id stays. Only distinct sets are compared, and only those that share a part."""
    rows = metas.select("query_id", F.array_sort(F.array_distinct("parts")).alias("parts"))
    sets = rows.groupBy("parts").agg(F.min("query_id").alias("least")).withColumn("n", F.size("parts"))
    each = sets.select("least", "n", F.explode("parts").alias("part"))
    other = each.select(F.col("least").alias("sup"), F.col("n").alias("m"), "part")
    shared = each.join(other, "part").where("m > n").groupBy("least", "n", "sup").agg(F.count("*").alias("shared"))
    inside = shared.where("shared = n").select("least").distinct().withColumn("inside", F.lit(True))
    judged = rows.join(sets.join(inside, "least", "left"), "parts")
    return judged.where(F.col("inside") | (F.col("query_id") != F.col("least"))).select("query_id")


def text_table(df: DataFrame, title: str = "") -> str:
    """A small report as text."""
    rows = [[str(v) for v in r] for r in df.collect()]
    width = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([title] * bool(title) + [line(df.columns), *map(line, rows)])


def latex_table(df: DataFrame) -> str:
    rows = [" & ".join(str(v) for v in r) + r" \\" for r in df.collect()]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", " & ".join(df.columns) + r" \\ \hline", *rows, r"\end{tabular}"])


def best_case(results: DataFrame, direction: str = "under") -> DataFrame:
    """The one query with the largest one-sided q-error: ``under`` true / (est + 1), ``over`` est / (true + 1); ties go to
    the least query_id."""
    error = {"under": under_error, "over": over_error}[direction](F.col("true_card"), F.col("est_card"))
    return results.withColumn("error", error).orderBy(F.col("error").desc_nulls_last(), "query_id").limit(1)


def merged_round(kept: DataFrame, found: DataFrame, keep: int = 100) -> DataFrame:
    """The best ``keep`` cases of the rounds so far and a new one by p_error, each query once with its largest error."""
    both = kept.select("query_id", "p_error").unionByName(found.select("query_id", "p_error"))
    best = both.groupBy("query_id").agg(F.max("p_error").alias("p_error"))
    return best.orderBy(F.col("p_error").desc_nulls_last(), "query_id").limit(keep)


def exact_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group as columns, from counts by value: groups are sorted by Spark (and spill), so no
    buffer holds all values of a group. Nulls are left out; groups without values give no row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    run = F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumns({"__last": run - 1, "__n": F.sum("__c").over(w)}).withColumn("__first", F.col("__last") - F.col("__c") + 1)
    aggs = []
    for name, share in shares.items():
        at = (F.col("__n") - 1) * F.lit(float(share))
        held = lambda i: F.max(F.when(i.between(F.col("__first"), F.col("__last")), F.col("__v").cast("double")))
        low, high = held(F.floor(at)), held(F.ceil(at))
        part = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * part).alias(name))
    return rows.groupBy(*keys).agg(*aggs)
