"""Queries over the driver tables, each with the DuckDB SQL that must give the same rows.

``_QUERIES`` maps a name to (function, SQL or None). Metric queries use a result relation that both sides derive from
``orders`` (``_results``): method = order priority, p_error between 1 and 21, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planscope.catalog import SHOP
from planscope.functions import metrics as mx
from planscope.meta import QueryMeta, RangeFilter, parse_sql, to_sql
from planscope.operators import cards as cd
from planscope.operators import cube as cb
from planscope.operators import relation as rl
from planscope.operators import reports as rp
from planscope.plans import optimizer as opt
from planscope.sources import files
from planscope.streaming import results as st

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[QueryFn, str | None]] = {}

#: How the oracle writes the integer value of a column.
INT = "CAST(trunc({c}) AS BIGINT)"


def _query(sql: str | None):
    def add(f: QueryFn) -> QueryFn:
        _QUERIES[f.__name__.lstrip("_")] = (f, sql)
        return f

    return add


def queries() -> dict[str, QueryFn]:
    from planscope import cube_queries, more_queries  # noqa: F401  they register their queries

    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {n: s for n, (_, s) in _QUERIES.items() if s is not None}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- counts of select-project-join queries -------------------------------------------------------------------------

R = RangeFilter
METAS = {
    "one_table": QueryMeta(("orders",), (R("o", "o_totalprice", 50_000, 250_000),)),
    "two_tables": QueryMeta(("orders", "customer"), (R("o", "o_totalprice", None, 200_000), R("c", "c_acctbal", 0, None))),
    "star": QueryMeta(("lineitem", "part", "supplier"), (R("l", "l_quantity", 10, 40), R("p", "p_size", 5, 25))),
    "chain": QueryMeta(("lineitem", "orders", "customer"), (R("c", "c_acctbal", 100, 5000), R("l", "l_quantity", 7, 7))),
    "siblings": QueryMeta(("orders", "events"), (R("o", "o_totalprice", 100_000, 300_000), R("e", "value", 10, 200))),
    "deep": QueryMeta(("lineitem", "supplier", "nation", "region"), (R("s", "s_acctbal", 0, 8000),)),
}


def _union_counts(metas: dict[str, QueryMeta]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS query_id, cardinality FROM ({to_sql(m, SHOP, value=INT, select='COUNT(*) AS cardinality')})" for n, m in metas.items())


@_query(to_sql(METAS["two_tables"], SHOP, value=INT, select="COUNT(*) AS cardinality"))
def _spj_count(spark, d):
    return rl.count_query(METAS["two_tables"], SHOP, rl.parquet_tables(spark, d))


@_query(_union_counts(METAS))
def _spj_count_multi(spark, d):
    return rl.count_batch(METAS, SHOP, rl.parquet_tables(spark, d))


@_query("SELECT COUNT(*) AS cardinality FROM orders o, events e WHERE o.o_custkey = e.user_id")
def _fk_fk_join_count(spark, d):
    return rl.count_query(QueryMeta(("orders", "events")), SHOP, rl.parquet_tables(spark, d))


@_query(to_sql(METAS["siblings"], SHOP, value=INT, via_keys=True, select="COUNT(*) AS cardinality"))
def _pk_fk_rewrite_count(spark, d):
    """Siblings joined through the table that owns their key."""
    return rl.count_query(METAS["siblings"].with_tables("customer"), SHOP, rl.parquet_tables(spark, d))


_PARSED = "select count(*) from orders o, customer c where o.o_custkey = c.c_custkey and o.o_totalprice > 99999 and o.o_totalprice <= 300000 and c.c_acctbal < 1000"


@_query("SELECT COUNT(*) AS cardinality FROM orders o, customer c WHERE o_custkey = c_custkey AND trunc(o_totalprice) > 99999 AND trunc(o_totalprice) <= 300000 AND trunc(c_acctbal) < 1000")
def _parsed_sql_count(spark, d):
    return rl.count_query(parse_sql(_PARSED, SHOP), SHOP, rl.parquet_tables(spark, d))


@_query("SELECT o_orderkey, c_custkey, l_linenumber FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND trunc(l_quantity) = 7 AND trunc(c_acctbal) BETWEEN 100 AND 5000")
def _joined_relation(spark, d):
    cols = ["o_o_orderkey", "c_c_custkey", "l_l_linenumber"]
    return rl.relation(METAS["chain"], SHOP, rl.parquet_tables(spark, d), cols).toDF("o_orderkey", "c_custkey", "l_linenumber")


@_query("SELECT COUNT(*) AS cardinality FROM supplier s, nation n WHERE s_nationkey = n_nationkey AND trunc(s_acctbal) >= 0")
def _forced_join_order_count(spark, d):
    m = QueryMeta(("supplier", "nation"), (R("s", "s_acctbal", 0, None),))
    return rl.relation(m, SHOP, rl.parquet_tables(spark, d), order=["nation", "supplier"], hints={"s": "shuffle_hash"}).agg(F.count("*").alias("cardinality"))


@_query("SELECT COUNT(*) AS n FROM events WHERE trunc(value) >= 100 AND value IS NOT NULL")
def _range_filter_nulls(spark, d):
    return rl.apply_filters(rl.prefixed(_t(spark, d, "events"), "e"), [R("e", "value", 100, None)]).agg(F.count("*").alias("n"))


@_query("SELECT COUNT(*) AS n FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL")
def _not_null_verify(spark, d):
    return rl.apply_filters(rl.prefixed(_t(spark, d, "orders"), "o"), [R("o", "o_totalprice"), R("o", "o_custkey")]).agg(F.count("*").alias("n"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", 1 - count({c})::DOUBLE / count(*) AS null_rate FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def _null_rate_columns(spark, d):
    return rl.null_rates(_t(spark, d, "events"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({INT.format(c=c)}) AS lo, max({INT.format(c=c)}) AS hi FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def _minmax_columns(spark, d):
    return rl.min_max(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@_query("SELECT p_size::BIGINT AS value, COUNT(*) AS cnt FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def _value_counts(spark, d):
    return rl.value_counts(_t(spark, d, "part"), "p_size")


@_query("SELECT s_nationkey, s_acctbal FROM supplier")
def _clipped_columns(spark, d):
    return rl.clip_columns(_t(spark, d, "supplier"), SHOP, "supplier")


@_query("SELECT c_custkey AS c_c_custkey, c_name AS c_c_name, c_nationkey AS c_c_nationkey, c_acctbal AS c_c_acctbal, c_mktsegment AS c_c_mktsegment FROM customer")
def _prefixed_scan(spark, d):
    return rl.prefixed(_t(spark, d, "customer"), "c")


# --- bins and cubes ------------------------------------------------------------------------------------------------


def _bins_sql(table: str, column: str, budget: int) -> str:
    """Boundaries as picked positions of the sorted column; the value column is named v."""
    v = INT.format(c=column)
    return f"""SELECT CASE WHEN v = min(v) OVER () THEN v - 1 ELSE v END AS v FROM (SELECT DISTINCT v FROM
      (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS p, count(*) OVER () AS n FROM {table} WHERE {column} IS NOT NULL)
      WHERE p IN (SELECT CAST(floor(i * (n - 1)::BIGINT / {budget}) AS BIGINT) FROM range(0, {budget + 1}) r(i)))"""


@_query(f"SELECT row_number() OVER (ORDER BY v) - 1 AS bin, v AS boundary FROM ({_bins_sql('orders', 'o_totalprice', 20)})")
def _bins_equidepth(spark, d):
    return cb.bin_boundaries(_t(spark, d, "orders"), "o_totalprice", 20)


@_query("SELECT row_number() OVER (ORDER BY v) - 1 AS bin, v AS boundary FROM (SELECT DISTINCT p_size::BIGINT AS v FROM part UNION SELECT min(p_size)::BIGINT - 1 FROM part)")
def _bins_distinct(spark, d):
    return cb.bin_boundaries(_t(spark, d, "part"), "p_size", 100)


BINS = {
    "l_quantity": [0, 10, 20, 30, 40, 50], "l_extendedprice": [0, 10_000, 30_000, 60_000, 80_000, 110_000], "l_discount": [-1, 0, 1],
    "o_totalprice": [0, 100_000, 200_000, 300_000, 400_000, 500_000], "value": [-1, 50, 100, 200, 300, 500],
}


def _bin_sql(column: str, bins: list[int]) -> str:
    return f"CAST(len(list_filter({bins}, lambda b: b < {INT.format(c=column)})) AS INTEGER)"


_CUBE2 = f"SELECT {_bin_sql('l_quantity', BINS['l_quantity'])} AS bin_l_quantity, {_bin_sql('l_extendedprice', BINS['l_extendedprice'])} AS bin_l_extendedprice, COUNT(*) AS cnt FROM lineitem GROUP BY 1, 2"


def _cube2(spark, d):
    return cb.cube(_t(spark, d, "lineitem"), {c: BINS[c] for c in ("l_quantity", "l_extendedprice")})


@_query(_CUBE2)
def _cube_2d(spark, d):
    return _cube2(spark, d)


@_query(f"""SELECT {_bin_sql('o_totalprice', BINS['o_totalprice'])} AS bin_o_totalprice, {_bin_sql('value', BINS['value'])} AS bin_value,
 {_bin_sql('c_acctbal', [-1000, 0, 3000, 6000, 10000])} AS bin_c_acctbal, COUNT(*) AS cnt
 FROM orders, events, customer WHERE o_custkey = c_custkey AND user_id = c_custkey GROUP BY 1, 2, 3""")
def _cube_3d(spark, d):
    joined = rl.relation(QueryMeta(("orders", "events", "customer")), SHOP, rl.parquet_tables(spark, d), ["o_o_totalprice", "e_value", "c_c_acctbal"]).toDF("o_totalprice", "value", "c_acctbal")
    return cb.cube(joined, {"o_totalprice": BINS["o_totalprice"], "value": BINS["value"], "c_acctbal": [-1000, 0, 3000, 6000, 10000]})


@_query(f"SELECT CAST(i AS INTEGER) AS bin, coalesce(cnt, 0) AS cnt FROM range(1, 8) r(i) LEFT JOIN (SELECT {_bin_sql('p_size', [0, 10, 20, 30, 40, 50, 60, 70])} AS b, COUNT(*) AS cnt FROM part GROUP BY 1) ON b = i")
def _marginal_zero_filled(spark, d):
    return cb.marginal(_t(spark, d, "part"), "p_size", [0, 10, 20, 30, 40, 50, 60, 70])


_RANGES = {"r1": (1, 2, 1, 3), "r2": (2, 5, 2, 2), "r3": (1, 5, 1, 5), "r4": (3, 3, 4, 5), "r5": (4, 5, 1, 1), "r6": (5, 5, 5, 5)}


def _ranges(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in _RANGES.items()], "query_id string, lo_l_quantity int, hi_l_quantity int, lo_l_extendedprice int, hi_l_extendedprice int")


def _ranges_direct() -> str:
    q, p = BINS["l_quantity"], BINS["l_extendedprice"]
    return " UNION ALL ".join(
        f"SELECT '{k}' AS query_id, COUNT(*) AS cardinality FROM lineitem WHERE trunc(l_quantity) > {q[a - 1]} AND trunc(l_quantity) <= {q[b]} AND trunc(l_extendedprice) > {p[c - 1]} AND trunc(l_extendedprice) <= {p[e]}"
        for k, (a, b, c, e) in _RANGES.items()
    )


@_query(_ranges_direct())
def _cube_slice_batch(spark, d):
    return cb.slice_batch(_cube2(spark, d), _ranges(spark), ["l_quantity", "l_extendedprice"])


_IND = f"""WITH c AS ({_CUBE2}), n AS (SELECT sum(cnt)::DOUBLE AS n FROM c),
 a AS (SELECT bin_l_quantity, sum(cnt)::DOUBLE AS m FROM c GROUP BY 1), b AS (SELECT bin_l_extendedprice, sum(cnt)::DOUBLE AS m FROM c GROUP BY 1),
 x AS (SELECT c.bin_l_quantity, c.bin_l_extendedprice, cnt, (a.m / n) * (b.m / n) * n AS expected FROM c JOIN a USING (bin_l_quantity) JOIN b USING (bin_l_extendedprice), n)"""


@_query(_IND + " SELECT bin_l_quantity, bin_l_extendedprice, cnt, round(expected, 6) AS expected FROM x")
def _independence_cells(spark, d):
    out = cb.independence(_cube2(spark, d), ["l_quantity", "l_extendedprice"])
    return out.select("bin_l_quantity", "bin_l_extendedprice", "cnt", F.round("expected", 6).alias("expected"))


@_query(_IND + " SELECT bin_l_quantity, bin_l_extendedprice, round(cnt / (expected + 1e-9), 6) AS ratio FROM x ORDER BY cnt / (expected + 1e-9) DESC LIMIT 5")
def _ratio_topk_under(spark, d):
    out = cb.independence(_cube2(spark, d), ["l_quantity", "l_extendedprice"]).orderBy(F.col("under_ratio").desc()).limit(5)
    return out.select("bin_l_quantity", "bin_l_extendedprice", F.round("under_ratio", 6).alias("ratio"))


@_query(_IND + " SELECT bin_l_quantity, bin_l_extendedprice, round(expected / (cnt + 1), 6) AS ratio FROM x ORDER BY expected / (cnt + 1) DESC LIMIT 5")
def _ratio_topk_over(spark, d):
    out = cb.independence(_cube2(spark, d), ["l_quantity", "l_extendedprice"]).orderBy(F.col("over_ratio").desc()).limit(5)
    return out.select("bin_l_quantity", "bin_l_extendedprice", F.round("over_ratio", 6).alias("ratio"))


@_query(_IND + """, r(query_id, qa, qb, pa, pb) AS (VALUES """ + ", ".join(f"('{k}', {a}, {b}, {c}, {e})" for k, (a, b, c, e) in _RANGES.items()) + """)
 SELECT query_id, round(n * (SELECT coalesce(sum(m), 0) FROM a WHERE bin_l_quantity BETWEEN qa AND qb) / n * (SELECT coalesce(sum(m), 0) FROM b WHERE bin_l_extendedprice BETWEEN pa AND pb) / n, 4) AS estimate FROM r, n""")
def _independence_estimate(spark, d):
    return cb.independent_ranges(_cube2(spark, d), _ranges(spark), ["l_quantity", "l_extendedprice"]).withColumn("estimate", F.round("estimate", 4))


_MARGINAL = f"SELECT {_bin_sql('o_totalprice', BINS['o_totalprice'])} AS bin, COUNT(*) AS cnt FROM orders GROUP BY 1"


def _marginal(spark, d):
    return cb.marginal(_t(spark, d, "orders"), "o_totalprice", BINS["o_totalprice"])


@_query(f"SELECT bin, round(sum(cnt) OVER (ORDER BY bin)::DOUBLE / sum(cnt) OVER (), 9) AS cdf FROM ({_MARGINAL})")
def _prefix_cdf(spark, d):
    return cb.prefix_cdf(_marginal(spark, d)).select("bin", F.round("cdf", 9).alias("cdf"))


@_query(f"SELECT bin, round((sum(cnt) OVER (ORDER BY bin) - cnt / 2)::DOUBLE / sum(cnt) OVER (), 9) AS mid FROM ({_MARGINAL})")
def _mid_quantile(spark, d):
    return cb.prefix_cdf(_marginal(spark, d)).select("bin", F.round("mid", 9).alias("mid"))


@_query(f"SELECT a.bin AS lo, b.bin AS hi, CAST(sum(c.cnt) AS BIGINT) AS cnt FROM ({_MARGINAL}) a JOIN ({_MARGINAL}) b ON a.bin <= b.bin JOIN ({_MARGINAL}) c ON c.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2")
def _interval_sums(spark, d):
    return cb.interval_sums(_marginal(spark, d))


@_query(f"""WITH m AS ({_MARGINAL}), i AS (SELECT a.bin AS lo, b.bin AS hi, CAST(sum(c.cnt * c.bin) AS BIGINT) AS benefit, CAST(sum(c.cnt) AS BIGINT) AS cost
 FROM m a JOIN m b ON a.bin <= b.bin JOIN m c ON c.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2)
 SELECT * FROM i WHERE cost <= 0.5 * (SELECT sum(cnt) FROM m) ORDER BY benefit DESC, lo, hi LIMIT 1""")
def _interval_best(spark, d):
    m = _marginal(spark, d)
    return cb.best_interval(m.withColumn("cnt", F.col("cnt") * F.col("bin")), m, 0.5)


@_query(f"SELECT bin, round(sum(cnt) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::DOUBLE / 3, 6) AS avg FROM ({_MARGINAL})")
def _moving_average3(spark, d):
    return cb.moving_average(_marginal(spark, d)).select("bin", F.round("avg", 6).alias("avg"))


_GAPS = [0, 10, 20, 30, 35, 36, 40, 50]
_GAP_SQL = f"SELECT {_bin_sql('p_size', _GAPS)} AS bin, CASE WHEN bin IN (1, 4, 5) THEN 0 ELSE COUNT(*) END AS cnt FROM part GROUP BY 1"


@_query(f"""WITH m AS ({_GAP_SQL}), x AS (SELECT bin, cnt,
 max(CASE WHEN cnt <> 0 THEN bin END) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lb,
 min(CASE WHEN cnt <> 0 THEN bin END) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rb FROM m),
 y AS (SELECT x.bin, coalesce(lb, rb) AS lb, coalesce(rb, lb) AS rb FROM x)
 SELECT y.bin, round(CASE WHEN lb = rb THEN l.cnt::DOUBLE ELSE l.cnt + (r.cnt - l.cnt) * ((y.bin - lb)::DOUBLE / (rb - lb)) END, 6) AS value FROM y JOIN m l ON l.bin = lb JOIN m r ON r.bin = rb""")
def _zero_interpolate(spark, d):
    m = cb.marginal(_t(spark, d, "part"), "p_size", _GAPS).withColumn("cnt", F.when(F.col("bin").isin(1, 4, 5), 0).otherwise(F.col("cnt")))
    return cb.fill_zeros(m).select("bin", F.round("value", 6).alias("value"))


@_query(f"""WITH m AS ({_MARGINAL}), s AS (SELECT *, CASE WHEN bin > 3 THEN 2 * (bin - 3) - 1 ELSE 2 * (3 - bin) END AS step FROM m),
 b AS (SELECT *, coalesce(sum(cnt) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT bin, cnt FROM b WHERE before < 8000""")
def _expand_from_centre(spark, d):
    return cb.expand_from(_marginal(spark, d), 3, 8000)


@_query("""WITH v(value) AS (VALUES (0::BIGINT), (17), (25), (49)), b AS (SELECT i AS bin, [0, 10, 20, 30, 40, 50][i + 1]::BIGINT AS boundary FROM range(0, 6) r(i))
 SELECT value, arg_min(bin, abs(boundary - value) * 1000 + bin) AS bin FROM v, b GROUP BY value""")
def _nearest_boundary(spark, d):
    bins = spark.createDataFrame([(i, b) for i, b in enumerate(BINS["l_quantity"])], "bin long, boundary long")
    return cb.nearest_boundary(bins, spark.createDataFrame([(0,), (17,), (25,), (49,)], "value long"))


def _feature_sql(table: str, columns: list[str]) -> str:
    part = "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, (avg(({c} - m) ** 4) / var_pop({c}) ** 2 - 3) AS kurtosis, (avg(({c} - m) ** 3) / var_pop({c}) ** 1.5) AS skewness FROM {t}, (SELECT avg({c}) AS m FROM {t})"
    return " UNION ALL ".join(part.format(c=c, t=table) for c in columns)


@_query(f"SELECT \"column\", distinct_values, round(kurtosis, 6) AS kurtosis, round(skewness, 6) AS skewness FROM ({_feature_sql('lineitem', ['l_quantity', 'l_extendedprice', 'l_discount'])})")
def _column_features(spark, d):
    out = cb.column_features(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "distinct_values", F.round("kurtosis", 6).alias("kurtosis"), F.round("skewness", 6).alias("skewness"))


@_query(f"""WITH f AS ({_feature_sql('lineitem', ['l_quantity', 'l_extendedprice', 'l_discount'])})
 SELECT "column", row_number() OVER (ORDER BY distinct_values, "column") + row_number() OVER (ORDER BY kurtosis, "column") + row_number() OVER (ORDER BY skewness, "column") - 3 AS score FROM f""")
def _column_rank(spark, d):
    return cb.rank_columns(cb.column_features(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])).select("column", F.col("score").cast("long").alias("score"))


@_query("SELECT b AS bin, count(*) AS covering FROM (SELECT unnest(range(1 + o_orderkey % 10, 2 + o_orderkey % 10 + o_custkey % 5)) AS b FROM orders) GROUP BY 1")
def _clip_coverage(spark, d):
    lo = F.col("o_orderkey") % 10 + 1
    return cb.coverage(_t(spark, d, "orders").select(lo.alias("lo"), (lo + F.col("o_custkey") % 5).alias("hi")))


@_query("""SELECT CAST(i AS INTEGER) AS bin, 1.0::DOUBLE + coalesce(e, 0) AS weight FROM range(1, 16) r(i) LEFT JOIN
 (SELECT b, sum(err)::DOUBLE AS e FROM (SELECT unnest(range(1 + o_orderkey % 10, 2 + o_orderkey % 10 + o_custkey % 5)) AS b, (o_orderkey % 7) * 0.5 AS err FROM orders) GROUP BY 1) ON b = i""")
def _weighted_benefit(spark, d):
    lo = F.col("o_orderkey") % 10 + 1
    return cb.weighted_benefit(_t(spark, d, "orders").select(lo.alias("lo"), (lo + F.col("o_custkey") % 5).alias("hi"), ((F.col("o_orderkey") % 7) * F.lit(0.5)).cast("double").alias("error")), 15)


@_query(f"SELECT bin_l_quantity * 6 + bin_l_extendedprice AS flat, cnt FROM (SELECT bin_l_quantity::BIGINT AS bin_l_quantity, bin_l_extendedprice, cnt FROM ({_CUBE2}))")
def _flat_cell_index(spark, d):
    return _cube2(spark, d).select(cb.flat_index([F.col("bin_l_quantity"), F.col("bin_l_extendedprice")], [6, 6]).alias("flat"), "cnt")


# --- metrics over results ------------------------------------------------------------------------------------------

_RES = """SELECT o_orderpriority AS method, o_orderkey AS query_id, 1 + (o_orderkey * 7919 % 1000) / 50.0::DOUBLE AS p_error, o_totalprice AS cost_actual,
 o_totalprice / (1 + (o_orderkey * 7919 % 1000) / 50.0::DOUBLE) AS cost_expected, (o_orderkey % 3600) AS elapsed,
 1 + o_orderkey * 31 % 5000 AS true_card, 1 + o_orderkey * 17 % 4000 AS est_card,
 ['orders', 't' || (o_custkey % 4)] AS tables, ['c' || (o_custkey % 3), 'b' || (o_custkey % 2)] AS columns FROM orders"""


def _results(spark, d) -> DataFrame:
    err = F.lit(1) + (F.col("o_orderkey") * 7919 % 1000) / F.lit(50.0)
    name = lambda p, n: F.concat(F.lit(p), (F.col("o_custkey") % n).cast("string"))
    return _t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("query_id"), err.alias("p_error"), F.col("o_totalprice").alias("cost_actual"),
        (F.col("o_totalprice") / err).alias("cost_expected"), (F.col("o_orderkey") % 3600).alias("elapsed"), (F.col("o_orderkey") * 31 % 5000 + 1).alias("true_card"),
        (F.col("o_orderkey") * 17 % 4000 + 1).alias("est_card"), F.array(F.lit("orders"), name("t", 4)).alias("tables"), F.array(name("c", 3), name("b", 2)).alias("columns"),
    )


def _res(sql: str) -> str:
    return f"WITH r AS ({_RES}) {sql}"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@_query(_res("SELECT method, max(p_error) AS max_p_error, round(quantile_cont(p_error, 0.9), 6) AS p90_p_error, round(quantile_cont(p_error, 0.75), 6) AS p75_p_error, round(median(p_error), 6) AS median_p_error, round(avg(p_error), 6) AS mean_p_error FROM r GROUP BY method"))
def _p_error_summary(spark, d):
    return _rounded(rp.metric_table(_results(spark, d), ["method"]), "p90_p_error", "p75_p_error", "median_p_error", "mean_p_error")


@_query(_res("SELECT method, min(p_error) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY p_error DESC) AS k FROM r) WHERE k <= 11 GROUP BY method"))
def _p_error_topk(spark, d):
    return rp.element_at_rank(_results(spark, d), ["method"], 10)


@_query(_res("""SELECT method, round(sum(cost_actual) / sum(cost_expected), 6) AS cumulative FROM (SELECT *, coalesce(sum(cost_expected) OVER (PARTITION BY method
 ORDER BY cost_actual / (cost_expected + 1.1) DESC, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) WHERE before < 1000000 GROUP BY method"""))
def _p_error_cumulative(spark, d):
    return _rounded(rp.cumulative_error(_results(spark, d), 1_000_000), "cumulative")


@_query(_res("SELECT method, count(*) FILTER (p_error > (SELECT quantile_cont(p_error, 0.9) FROM r)) AS notable FROM r GROUP BY method"))
def _p_error_notable(spark, d):
    return rp.notable(_results(spark, d), 0.9)


@_query(_res("SELECT list_sort(tables) AS tables, list_sort(columns) AS columns, max(p_error) AS max_p_error, round(quantile_cont(p_error, 0.9), 6) AS p90_p_error, round(quantile_cont(p_error, 0.75), 6) AS p75_p_error, round(median(p_error), 6) AS median_p_error FROM r GROUP BY ALL"))
def _template_stats(spark, d):
    return _rounded(rp.template_stats(_results(spark, d)), "p90_p_error", "p75_p_error", "median_p_error")


@_query(_res("SELECT list_sort(tables) AS tables, list_sort(columns) AS columns, round(median(p_error), 6) AS score FROM r GROUP BY ALL ORDER BY median(p_error) DESC, 1, 2 LIMIT 5"))
def _template_rank(spark, d):
    out = rp.template_stats(_results(spark, d)).orderBy(F.col("median_p_error").desc(), "tables", "columns").limit(5)
    return out.select("tables", "columns", F.round("median_p_error", 6).alias("score"))


@_query(_res("SELECT tables, columns, p_error, query_id FROM (SELECT list_sort(tables) AS tables, list_sort(columns) AS columns, p_error, query_id, row_number() OVER (PARTITION BY list_sort(tables) ORDER BY p_error DESC, query_id) AS k FROM r) WHERE k <= 3"))
def _template_dedup_topk(spark, d):
    rows = _results(spark, d).select(*rp.template_key(F.col("tables"), F.col("columns")), "p_error", "query_id")
    return rp.top_k(rows, ["tables"], [F.col("p_error").desc(), F.col("query_id")], 3).drop("rank")


@_query(_res("SELECT method, query_id, p_error FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY p_error DESC, query_id) AS k FROM r) WHERE k <= 5"))
def _top_cases_per_method(spark, d):
    return rp.top_k(_results(spark, d), ["method"], [F.col("p_error").desc(), F.col("query_id")], 5).select("method", "query_id", "p_error")


@_query(_res("SELECT method, least(elapsed // 180, 17) AS bucket, count(*) AS n, max(p_error) AS max_p_error, round(median(p_error), 6) AS median_p_error FROM r GROUP BY 1, 2"))
def _time_bucket_metrics(spark, d):
    return _rounded(rp.time_buckets(_results(spark, d), 180, 3060.0), "median_p_error")


@_query(_res("SELECT method, round(regr_slope(max_p_error, bucket::DOUBLE), 6) AS slope FROM (SELECT method, elapsed // 180 AS bucket, max(p_error) AS max_p_error FROM r GROUP BY 1, 2) GROUP BY method"))
def _metric_slope(spark, d):
    return _rounded(rp.slope(rp.time_buckets(_results(spark, d), 180), "max_p_error", "bucket", ["method"]), "slope")


@_query(_res("SELECT method, round(sum(cost_expected * elapsed) / sum(cost_expected * cost_expected), 9) AS rate FROM r GROUP BY method"))
def _time_per_cost(spark, d):
    return _rounded(rp.through_origin(_results(spark, d), "elapsed", "cost_expected", ["method"]), "rate", digits=9)


@_query(_res("SELECT query_id, round(greatest(true_card / est_card, est_card / true_card), 6) AS q_error, round(est_card / (true_card + 1), 6) AS over_error, round(true_card / (est_card + 1), 6) AS under_error FROM r"))
def _q_error_all(spark, d):
    t, e = F.col("true_card"), F.col("est_card")
    return _results(spark, d).select("query_id", F.round(mx.q_error(t, e), 6).alias("q_error"), F.round(mx.over_error(t, e), 6).alias("over_error"), F.round(mx.under_error(t, e), 6).alias("under_error"))


@_query(_res("SELECT query_id, round(greatest(true_card / est_card, est_card / true_card), 6) AS q_error FROM r ORDER BY greatest(true_card / est_card, est_card / true_card) DESC, query_id LIMIT 10"))
def _q_error_topk(spark, d):
    q = mx.q_error(F.col("true_card"), F.col("est_card"))
    return _results(spark, d).select("query_id", q.alias("q")).orderBy(F.col("q").desc(), "query_id").limit(10).select("query_id", F.round("q", 6).alias("q_error"))


@_query(_res("SELECT round(avg(q), 6) AS arithmetic, round(exp(avg(ln(q))), 6) AS geometric, round(count(q) / sum(1 / q), 6) AS harmonic FROM (SELECT greatest(true_card / est_card, est_card / true_card) AS q FROM r)"))
def _q_error_means(spark, d):
    q = F.col("q")
    rows = _results(spark, d).select(mx.q_error(F.col("true_card"), F.col("est_card")).alias("q"))
    return rows.agg(F.round(F.avg(q), 6).alias("arithmetic"), F.round(mx.geometric_mean(q), 6).alias("geometric"), F.round(mx.harmonic_mean(q), 6).alias("harmonic"))


@_query(_res("SELECT round(max(q), 6) AS worst, round(quantile_cont(q, 0.95), 6) AS p95, round(quantile_cont(q, 0.9), 6) AS p90, round(quantile_cont(q, 0.75), 6) AS p75, round(median(q), 6) AS median FROM (SELECT greatest((true_card + 1) / (est_card + 1), (est_card + 1) / (true_card + 1)) AS q FROM r)"))
def _workload_error_state(spark, d):
    rows = _results(spark, d).select(mx.q_error(F.col("true_card"), F.col("est_card"), 1).alias("q"))
    p = lambda x: F.round(F.percentile("q", F.lit(x)), 6)
    return rows.agg(F.round(F.max("q"), 6).alias("worst"), p(0.95).alias("p95"), p(0.9).alias("p90"), p(0.75).alias("p75"), p(0.5).alias("median"))


@_query(_res("SELECT i / 10.0::DOUBLE AS share, round(quantile_cont(q, i / 10.0::DOUBLE), 6) AS decile FROM (SELECT est_card / (true_card + 1) AS q FROM r), range(0, 10) t(i) GROUP BY i").replace("quantile_cont(q, i / 10.0::DOUBLE)", "list_extract(quantile_cont(q, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), CAST(i + 1 AS INTEGER))"))
def _error_deciles(spark, d):
    rows = _results(spark, d).select(mx.over_error(F.col("true_card"), F.col("est_card")).alias("q"))
    row = rows.agg(F.percentile("q", F.array(*[F.lit(i / 10) for i in range(10)])).alias("p"))
    return row.select(F.posexplode("p").alias("i", "v")).select((F.col("i") / F.lit(10.0)).alias("share"), F.round("v", 6).alias("decile"))


@_query(_res("SELECT round(1 - sum((t - e) ** 2) / (var_pop(t) * count(*)), 6) AS r2, round(avg(abs((t - e) / t)), 6) AS mape FROM (SELECT ln(1 + true_card) AS t, ln(1 + est_card) AS e FROM r)"))
def _card_est_r2_mape(spark, d):
    return _rounded(rp.fit_quality(_results(spark, d), "true_card", "est_card"), "r2", "mape")


@_query(_res("SELECT query_id, CASE WHEN true_card / est_card >= 1.25 THEN 'under' WHEN true_card / est_card <= 0.8 THEN 'over' ELSE 'exact' END AS mode, round(CASE WHEN est_card >= true_card * 10 THEN 1 ELSE (est_card - true_card) / (true_card * 9.0::DOUBLE) END, 6) AS benefit FROM r"))
def _error_mode_benefit(spark, d):
    t, e = F.col("true_card"), F.col("est_card")
    return _results(spark, d).select("query_id", mx.error_mode(t, e).alias("mode"), F.round(mx.clipped_benefit(e, t, 10), 6).alias("benefit"))


@_query(_res("SELECT query_id, round(ln(true_card / est_card) / (1 + 100.0::DOUBLE / (true_card + 1)), 6) AS objective, round(greatest(0, least(1, (p_error - 1) / 4)), 6) AS ramp FROM r"))
def _objective_values(spark, d):
    t, e = F.col("true_card"), F.col("est_card")
    return _results(spark, d).select("query_id", F.round(mx.objective(t / e.cast("double"), t), 6).alias("objective"), F.round(mx.error_to_benefit(F.col("p_error")), 6).alias("ramp"))


@_query(_res("SELECT method, round(avg(est_card / true_card), 6) AS error_oriented, round(sum(est_card)::DOUBLE / sum(true_card), 6) AS cost_oriented FROM r GROUP BY method"))
def _benefit_aggregate(spark, d):
    return _results(spark, d).groupBy("method").agg(F.round(F.avg(F.col("est_card") / F.col("true_card")), 6).alias("error_oriented"), F.round(F.sum("est_card") / F.sum("true_card"), 6).alias("cost_oriented"))


@_query(_res("SELECT method, greatest(CASE WHEN max(p_error) FILTER (k > 5) IS NULL THEN max(p_error) FILTER (k <= 5) - 1 ELSE max(p_error) FILTER (k <= 5) - max(p_error) FILTER (k > 5) END, 1) AS improvement FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY elapsed DESC, query_id DESC) AS k FROM r) GROUP BY method"))
def _recent_improvement(spark, d):
    return rp.improvement(_results(spark, d), ["method"])


@_query(_res("SELECT method, query_id, p_error FROM (SELECT *, row_number() OVER (PARTITION BY method, list_sort(tables), list_sort(columns) ORDER BY p_error DESC, query_id) AS k FROM r) WHERE k = 1"))
def _dedup_best_instance(spark, d):
    rows = _results(spark, d).withColumns({"t": F.array_sort("tables"), "c": F.array_sort("columns")})
    return rp.dedup_best(rows, ["method", "t", "c"], [F.col("p_error").desc(), F.col("query_id")]).select("method", "query_id", "p_error")


@_query(_res("SELECT method, count(*) FILTER (p_error > 1 + 1e-5) AS valid, count(*) FILTER (p_error <= 1 + 1e-5) AS invalid, count(*) FILTER (true_card BETWEEN 10 AND 2000) AS in_window FROM r GROUP BY method"))
def _instance_validity(spark, d):
    ok = F.col("p_error") > 1 + 1e-5
    return _results(spark, d).groupBy("method").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_if(F.col("true_card").between(10, 2000)).alias("in_window"))


@_query(_res("SELECT tables, a, b, round(label, 6) AS label FROM (SELECT list_sort(tables) AS tables, query_id AS a, lead(query_id) OVER w AS b, ln((true_card + 1.0::DOUBLE) / (lead(true_card) OVER w + 1.0::DOUBLE)) AS label FROM r WINDOW w AS (PARTITION BY list_sort(tables) ORDER BY query_id)) WHERE b IS NOT NULL"))
def _pair_log_ratio(spark, d):
    rows = _results(spark, d).select(F.array_sort("tables").alias("tables"), "query_id", F.col("true_card").alias("card"))
    return _rounded(cd.log_ratio_pairs(rows), "label")


# --- lattices and cardinality tables -------------------------------------------------------------------------------

_SETS = [list(s) for s in SHOP.sub_joins(["customer", "orders", "lineitem", "part"], 1)]
_LATTICE = "SELECT aliases FROM (VALUES " + ", ".join(f"({s})" for s in _SETS) + ") v(aliases)"


@_query("SELECT 'q' AS query_id, aliases FROM (VALUES (['c']), (['l']), (['o']), (['p']), (['c', 'o']), (['l', 'o']), (['l', 'p']), (['c', 'l', 'o']), (['l', 'o', 'p']), (['c', 'l', 'o', 'p'])) v(aliases)")
def _lattice_subjoins(spark, d):
    return cd.lattice(spark, SHOP, ["customer", "orders", "lineitem", "part"])


@_query(f"WITH x AS ({_LATTICE}) SELECT a.aliases AS sub, b.aliases AS sup, list_filter(b.aliases, lambda z: NOT list_contains(a.aliases, z))[1] AS added FROM x a JOIN x b ON list_has_all(b.aliases, a.aliases) AND len(b.aliases) = len(a.aliases) + 1")
def _lattice_edges(spark, d):
    return cd.edges(cd.lattice(spark, SHOP, ["customer", "orders", "lineitem", "part"])).select("sub", "sup", "added")


_CARD_ROWS = [(s, (i * 37 + 11) ** 2 if i % 3 else None, (i * 53 + 7) ** 2) for i, s in enumerate(_SETS)]
_CARDS = "SELECT * FROM (VALUES " + ", ".join(f"({s}, {'NULL' if t is None else t}::BIGINT, {e}::BIGINT)" for s, t, e in _CARD_ROWS) + ") v(aliases, t, e)"


def _cards(spark) -> DataFrame:
    return spark.createDataFrame([("q", *r) for r in _CARD_ROWS], "query_id string, aliases array<string>, true long, est long")


@_query(f"SELECT aliases FROM ({_CARDS}) WHERE t IS NULL")
def _card_missing(spark, d):
    return cd.missing(cd.lattice(spark, SHOP, ["customer", "orders", "lineitem", "part"]), _cards(spark)).select("aliases")


@_query(f"""WITH c AS ({_CARDS}), p AS (SELECT a.aliases, a.e AS qe, k.t, k.e, row_number() OVER (PARTITION BY a.aliases ORDER BY len(k.aliases) DESC, array_to_string(k.aliases, ',')) AS n
 FROM c a JOIN c k ON a.t IS NULL AND k.t IS NOT NULL AND list_has_all(a.aliases, k.aliases))
 SELECT c.aliases, round(coalesce(c.t::DOUBLE, p.t::DOUBLE * p.qe / p.e, c.e::DOUBLE), 6) AS inferred FROM c LEFT JOIN p ON c.aliases = p.aliases AND n = 1""")
def _card_ratio_complete(spark, d):
    return _rounded(cd.ratio_completed(_cards(spark)).select("aliases", "inferred"), "inferred")


@_query(f"""WITH c AS ({_CARDS}), f(alias, factor) AS (VALUES ('o', 2.0::DOUBLE), ('p', 0.5::DOUBLE)),
 x AS (SELECT aliases, exp(sum(ln(factor))) AS f FROM c, f WHERE list_contains(aliases, alias) GROUP BY aliases)
 SELECT c.aliases, round(c.t * coalesce(x.f, 1), 6) AS inferred FROM c LEFT JOIN x ON c.aliases = x.aliases""")
def _card_case_scaled(spark, d):
    factors = spark.createDataFrame([("q", "o", 2.0), ("q", "p", 0.5)], "query_id string, alias string, factor double")
    return _rounded(cd.case_scaled(_cards(spark), factors).select("aliases", "inferred"), "inferred")


@_query(f"""WITH c AS ({_CARDS}), g AS (SELECT b.aliases, avg((10.0::DOUBLE + a.t) / (10.0::DOUBLE + a.e)) AS rate FROM c a JOIN c b ON list_has_all(b.aliases, a.aliases) AND len(b.aliases) = len(a.aliases) + 1 AND a.t IS NOT NULL GROUP BY b.aliases)
 SELECT c.aliases, round(coalesce(c.t::DOUBLE, c.e * coalesce(rate, 1)), 6) AS inferred FROM c LEFT JOIN g ON c.aliases = g.aliases""")
def _card_neighbor_direct(spark, d):
    return _rounded(cd.neighbour_completed(_cards(spark)).select("aliases", "inferred"), "inferred")


@_query(f"SELECT round(sum(abs(ln((t + 1000.0::DOUBLE) / (e + 1000.0::DOUBLE)))), 6) AS distance FROM ({_CARDS})")
def _card_log_distance(spark, d):
    est = _cards(spark).select("query_id", "aliases", F.col("est").alias("true"))
    return _rounded(cd.log_distance(_cards(spark), est).select("distance"), "distance")


@_query(f"SELECT aliases, coalesce(CASE WHEN len(aliases) = 2 THEN 5 END, t) AS \"true\", e AS est FROM ({_CARDS})")
def _card_merge(spark, d):
    new = _cards(spark).where(F.size("aliases") == 2).select("query_id", "aliases", F.lit(5).cast("long").alias("true"), F.lit(None).cast("long").alias("est"))
    return cd.merged(_cards(spark), new).select("aliases", "true", "est")


@_query("""WITH m AS (SELECT o_orderkey AS query_id, list_sort(list_distinct(['t' || (o_custkey % 6), 'f' || (o_orderkey % 11), 'f' || (o_orderkey % 3)])) AS parts FROM orders),
 s AS (SELECT parts, min(query_id) AS least FROM m GROUP BY parts)
 SELECT m.query_id FROM m JOIN s ON m.parts = s.parts WHERE m.query_id <> s.least OR EXISTS (SELECT 1 FROM s z WHERE len(z.parts) > len(s.parts) AND list_has_all(z.parts, s.parts))""")
def _subsumed_instances(spark, d):
    part = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    return rp.subsumed(_t(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.array(part("t", "o_custkey", 6), part("f", "o_orderkey", 11), part("f", "o_orderkey", 3)).alias("parts")))


# --- plans, logs, streams ------------------------------------------------------------------------------------------


@_query(None)
def _p_error_trace(spark, d):
    """Exact and independence cardinalities of all parts of three queries, plans under both, and their P-error."""
    from planscope.functions.estimators import Exact, Independence

    tables = rl.parquet_tables(spark, d)
    exact, guess = Exact(SHOP, tables), Independence.from_tables(SHOP, tables, ["customer", "orders", "lineitem", "part", "supplier", "events"])
    rows = []
    for name, m in {
        "chain": QueryMeta(("customer", "orders", "lineitem"), (R("c", "c_acctbal", 0, 3000), R("o", "o_totalprice", 100_000, 400_000))),
        "star": QueryMeta(("lineitem", "orders", "part", "supplier"), (R("p", "p_size", 1, 10), R("l", "l_quantity", 1, 5))),
        "siblings": QueryMeta(("customer", "orders", "events"), (R("e", "value", 0, 20), R("c", "c_acctbal", 5000, None))),
    }.items():
        aliases = m.alias_key(SHOP)
        r = opt.p_error(aliases, exact.sub_joins(m, SHOP), guess.sub_joins(m, SHOP), opt.connected_in(SHOP))
        rows.append((name, r["p_error"], r["cost_estimation"], r["cost_true"], r["plan_estimation"], r["plan_true"]))
    return spark.createDataFrame(rows, "query string, p_error double, cost_estimation double, cost_true double, plan_estimation string, plan_true string")


@_query("SELECT ['c' || (o_custkey % 5), 'o'] AS aliases, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS card, (o_orderkey % 100) / 10.0::DOUBLE AS seconds, true AS subquery FROM orders")
def _async_log_parse(spark, d):
    line = F.concat(F.lit("('o', 'c"), F.col("o_custkey") % 5, F.lit("')#SELECT 1#"), F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_orderkey")), F.lit("#"), (F.col("o_orderkey") % 100) / 10)
    return files.async_log(_t(spark, d, "orders").select(line.alias("value"))).select("aliases", "card", "seconds", "subquery")


@_query("SELECT ['a' || (o_custkey % 3), 'b'] AS aliases, o_orderkey AS rows, CAST(8 AS INTEGER) AS width FROM orders")
def _planner_log_parse(spark, d):
    line = F.concat(F.lit("RELOPTINFO (b a"), F.col("o_custkey") % 3, F.lit("): rows="), F.col("o_orderkey"), F.lit(" width=8"))
    return files.reloptinfo(_t(spark, d, "orders").select(line.alias("value")))


@_query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2")
def _stream_window_counts(spark, d):
    return st.windowed(_t(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Cube cardinalities against direct counts and the independence estimate over customer, orders and events."""
    cols = {"c_acctbal": "c_c_acctbal", "o_totalprice": "o_o_totalprice", "value": "e_value"}
    joined = rl.relation(QueryMeta(("customer", "orders", "events")), SHOP, rl.parquet_tables(spark, d), list(cols.values())).toDF(*cols)
    bins = {c: cb.collect_bins(cb.bin_boundaries(joined, c, 20)) for c in cols}
    cells = cb.cube(joined, bins)
    picks = {"q1": (1, 5), "q2": (3, 9), "q3": (1, 20), "q4": (8, 12), "q5": (2, 3), "q6": (10, 20)}
    fixed = {q: {c: (min(a, len(b) - 1), min(z, len(b) - 1)) for c, b in bins.items()} for q, (a, z) in picks.items()}
    ranges = spark.createDataFrame([(q, *[x for c in cols for x in r[c]]) for q, r in fixed.items()], "query_id string, " + ", ".join(f"lo_{c} int, hi_{c} int" for c in cols))
    metas = {q: QueryMeta(("customer", "orders", "events"), tuple(R(a, c, bins[c][r[c][0] - 1] + 1, bins[c][r[c][1]]) for a, c in (("c", "c_acctbal"), ("o", "o_totalprice"), ("e", "value")))) for q, r in fixed.items()}
    direct = rl.count_batch(metas, SHOP, rl.parquet_tables(spark, d)).withColumnRenamed("cardinality", "true_card_direct")
    sliced = cb.slice_batch(cells, ranges, list(cols)).withColumnRenamed("cardinality", "true_card_cube")
    guess = cb.independent_ranges(cells, ranges, list(cols)).withColumnRenamed("estimate", "independence_estimate")
    out = sliced.join(direct, "query_id").join(guess, "query_id")
    return out.withColumn("q_error", mx.q_error(F.col("true_card_cube"), F.col("independence_estimate"), 1))


def _flagship_sql() -> str:
    cols = {"c": "c_acctbal", "o": "o_totalprice", "e": "value"}
    lists = ", ".join(f"b{a} AS (SELECT list(v ORDER BY v) AS {a} FROM ({_bins_sql('j', c, 20)}))" for a, c in cols.items())
    edges = ", ".join(f"{a}[least(a, len({a}) - 1)] AS lo_{a}, {a}[least(z, len({a}) - 1) + 1] AS hi_{a}" for a in cols)
    inside = {a: f"{INT.format(c=c)} > lo_{a} AND {INT.format(c=c)} <= hi_{a}" for a, c in cols.items()}
    return f"""WITH j AS (SELECT c_acctbal, o_totalprice, value FROM customer, orders, events WHERE o_custkey = c_custkey AND user_id = c_custkey),
 {lists}, r(query_id, a, z) AS (VALUES ('q1', 1, 5), ('q2', 3, 9), ('q3', 1, 20), ('q4', 8, 12), ('q5', 2, 3), ('q6', 10, 20)),
 f AS (SELECT query_id, {edges} FROM r, bc, bo, be),
 k AS (SELECT query_id, count(*) AS n, count(*) FILTER ({" AND ".join(inside.values())}) AS t, {", ".join(f"count(*) FILTER ({x}) AS k{a}" for a, x in inside.items())}
  FROM f, j WHERE c_acctbal IS NOT NULL AND o_totalprice IS NOT NULL AND value IS NOT NULL GROUP BY query_id),
 g AS (SELECT query_id, t, n::DOUBLE * kc / n * ko / n * ke / n AS e FROM k)
 SELECT query_id, t AS true_card_cube, t AS true_card_direct, e AS independence_estimate, greatest((t + 1) / (e + 1), (e + 1) / (t + 1)) AS q_error FROM g"""


@_query(_flagship_sql())
def _flagship_cube_check(spark, d):
    return flagship(spark, d)
