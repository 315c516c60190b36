"""Queries over template cubes and card tables; registered beside those of ``catalog_queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from planscope.catalog import SHOP
from planscope.catalog_queries import _CARDS, _IND, _RANGES, BINS, INT, R, _bin_sql, _bins_sql, _cards, _cube2, _query, _ranges_direct, _res, _results, _rounded, _t, _union_counts
from planscope.functions.estimators import Independence
from planscope.meta import QueryMeta, to_sql
from planscope.operators import cards as cd
from planscope.operators import cube as cb
from planscope.operators import relation as rl
from planscope.operators import reports as rp
from planscope.operators import template_cube as tc

#: Boundaries of the template cubes below.
EDGES = {
    ("c", "c_acctbal"): [-1000, 0, 3000, 6000, 10_000], ("o", "o_totalprice"): BINS["o_totalprice"], ("e", "value"): BINS["value"],
    ("l", "l_quantity"): BINS["l_quantity"], ("p", "p_size"): [0, 10, 20, 30, 40, 50],
}
SIBLINGS = ("customer", "events", "orders")
SIBLING_METAS = {
    "all": QueryMeta(SIBLINGS),
    "one": QueryMeta(SIBLINGS, (R("o", "o_totalprice", 100_001, 300_000),)),
    "known": QueryMeta(SIBLINGS, (R("e", "value"), R("c", "c_acctbal", None, 0))),
    "three": QueryMeta(SIBLINGS, (R("o", "o_totalprice", 100_001, 400_000), R("e", "value", 51, 200), R("c", "c_acctbal", 1, 6000))),
    "empty": QueryMeta(SIBLINGS, (R("e", "value", 201, 100),)),
    "unaligned": QueryMeta(SIBLINGS, (R("o", "o_totalprice", 123_456, 222_222), R("c", "c_acctbal", 1, None))),
}


@_query(_union_counts(SIBLING_METAS))
def _template_cube_counts(spark, d):
    """Counts of a template's queries from its cube; bounds that are no bin edges are counted directly."""
    tables = rl.parquet_tables(spark, d)
    return tc.TemplateCube.build(SIBLINGS, SHOP, tables, EDGES).counts_or_direct(SIBLING_METAS, SHOP, tables)


CHAIN = ("customer", "lineitem", "orders", "part")
CHAIN_METAS = {
    "a": QueryMeta(CHAIN, (R("c", "c_acctbal", 1, 6000), R("l", "l_quantity", 11, 40), R("p", "p_size", None, 20))),
    "b": QueryMeta(CHAIN, (R("o", "o_totalprice", 200_001, None), R("l", "l_quantity", None, 10))),
}


def _plan_cards_sql() -> str:
    parts = [
        f"SELECT '{n}' AS query_id, {list(key)} AS aliases, cardinality FROM ({to_sql(m.restricted(key, SHOP), SHOP, value=INT, select='COUNT(*) AS cardinality')})"
        for key in SHOP.sub_joins(CHAIN, 1) for n, m in CHAIN_METAS.items()
    ]
    return " UNION ALL ".join(parts)


@_query(_plan_cards_sql())
def _plan_cards_from_cubes(spark, d):
    """All parts of two queries, single tables included, from one cube per part."""
    return tc.plan_cards(tc.sub_join_cubes(CHAIN, SHOP, rl.parquet_tables(spark, d), EDGES), CHAIN_METAS, SHOP)


@_query(f"""WITH s AS ({_bins_sql('part', 'p_size', 10)}), r AS ({_bins_sql('part', 'p_retailprice', 10)})
 SELECT CAST((SELECT count(*) FROM s WHERE s.v < trunc(p_size)) AS INTEGER) AS bin_p_p_size, CAST((SELECT count(*) FROM r WHERE r.v < trunc(p_retailprice)) AS INTEGER) AS bin_p_p_retailprice, count(*) AS cnt FROM part GROUP BY 1, 2""")
def _table_cube_cells(spark, d):
    """The cube of a table's best columns, with a cell budget of 100 shared between them."""
    return tc.table_cube("part", SHOP, rl.parquet_tables(spark, d), 2, 100).cells


_LINE = {("l", "l_quantity"): BINS["l_quantity"], ("l", "l_extendedprice"): BINS["l_extendedprice"]}


def _line_cube(spark, d) -> tc.TemplateCube:
    return tc.TemplateCube.build(["lineitem"], SHOP, rl.parquet_tables(spark, d), _LINE)


def _region_rows() -> str:
    q, p = BINS["l_quantity"], BINS["l_extendedprice"]
    rows = [f"('{k}', {q[a - 1] + 1}::BIGINT, {q[b]}::BIGINT, {p[c - 1] + 1}::BIGINT, {p[e]}::BIGINT)" for k, (a, b, c, e) in _RANGES.items()]
    return "(VALUES " + ", ".join(rows) + ") v(query_id, lower_l_l_quantity, upper_l_l_quantity, lower_l_l_extendedprice, upper_l_l_extendedprice)"


@_query(f"SELECT v.*, cardinality FROM {_region_rows()} JOIN ({_ranges_direct()}) USING (query_id)")
def _region_labels(spark, d):
    """Value ranges and exact counts of regions given by bin numbers."""
    regions = spark.createDataFrame([(k, *v) for k, v in _RANGES.items()], "query_id string, lo_l_l_quantity int, hi_l_l_quantity int, lo_l_l_extendedprice int, hi_l_l_extendedprice int")
    return _line_cube(spark, d).region_labels(regions)


_CELLS = [0, 6, 12, 18, 24]


def _cell_sql() -> str:
    q, p = BINS["l_quantity"], BINS["l_extendedprice"]
    one = "SELECT '{n}' AS query_id, count(*) AS cardinality FROM lineitem WHERE trunc(l_quantity) > {a} AND trunc(l_quantity) <= {b} AND trunc(l_extendedprice) > {c} AND trunc(l_extendedprice) <= {e}"
    return " UNION ALL ".join(one.format(n=n, a=q[n // 5], b=q[n // 5 + 1], c=p[n % 5], e=p[n % 5 + 1]) for n in _CELLS)


@_query(_cell_sql())
def _cell_labels(spark, d):
    """Exact counts of single cells by their row-major number."""
    c = _line_cube(spark, d)
    return c.counts(c.cell_metas(_CELLS))


@_query(f"""WITH b AS (SELECT count(*) AS n, min({INT.format(c='l_quantity')}) AS lo, max({INT.format(c='l_quantity')}) AS hi FROM lineitem),
 r(query_id, a, z) AS (VALUES ('x', 11::BIGINT, 20::BIGINT), ('y', 1, 40), ('z', 41, 50)),
 g AS (SELECT query_id, n * (greatest(0, least(z, hi) - greatest(a, lo) + 1)::DOUBLE / greatest(1, hi - lo + 1)) AS estimate, a, z FROM r, b),
 t AS (SELECT query_id, count(*) AS cardinality FROM r JOIN lineitem ON trunc(l_quantity) BETWEEN a AND z GROUP BY query_id)
 SELECT query_id, cardinality, round(estimate, 6) AS estimate, round(greatest((cardinality + 1) / (estimate + 1), (estimate + 1) / (cardinality + 1)), 6) AS q_error FROM g JOIN t USING (query_id)""")
def _estimator_on_regions(spark, d):
    """An estimator's q-errors on regions whose exact counts come from a cube."""
    tables = rl.parquet_tables(spark, d)
    metas = {n: QueryMeta(("lineitem",), (R("l", "l_quantity", a, z),)) for n, (a, z) in {"x": (11, 20), "y": (1, 40), "z": (41, 50)}.items()}
    return _rounded(_line_cube(spark, d).evaluated(metas, Independence.from_tables(SHOP, tables, ["lineitem"])), "estimate", "q_error")


@_query(_IND + " SELECT bin_l_quantity, bin_l_extendedprice, cnt, round(cnt / (expected + 1e-9), 6) AS under_ratio FROM x WHERE cnt / (expected + 1e-9) > 0.9")
def _nontrivial_cells(spark, d):
    out = tc.nontrivial_cells(_cube2(spark, d), ["l_quantity", "l_extendedprice"], 0.9)
    return _rounded(out, "under_ratio").select("bin_l_quantity", "bin_l_extendedprice", "cnt", "under_ratio")


_MANY = {"l_quantity": BINS["l_quantity"], "l_extendedprice": BINS["l_extendedprice"], "l_discount": [-1, 0, 1, 2]}


@_query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(i AS INTEGER) AS bin, coalesce(cnt, 0) AS cnt FROM range(1, {len(b)}) r(i) LEFT JOIN (SELECT {_bin_sql(c, b)} AS b, count(*) AS cnt FROM lineitem GROUP BY 1) ON b = i"
    for c, b in _MANY.items()))
def _marginals_of_columns(spark, d):
    """Marginals of several columns from one pass over the rows."""
    return cb.marginals(_t(spark, d, "lineitem"), _MANY)


@_query(_IND + " SELECT CAST(sum(cnt) AS BIGINT) AS total, count(*) AS cells, count(DISTINCT bin_l_quantity) AS bins_l_quantity, count(DISTINCT bin_l_extendedprice) AS bins_l_extendedprice FROM x")
def _cube_summary(spark, d):
    return cb.summary(_cube2(spark, d), ["l_quantity", "l_extendedprice"])


@_query(f"SELECT aliases, t AS \"true\", e AS est FROM ({_CARDS}) WHERE len(aliases) <> 2")
def _card_intersection(spark, d):
    other = _cards(spark).withColumn("est", F.when(F.size("aliases") == 2, F.col("est") + 1).otherwise(F.col("est")))
    return cd.intersection(_cards(spark), other).select("aliases", "true", "est")


@_query(_res("SELECT query_id, round(true_card / (est_card + 1), 6) AS error FROM r ORDER BY true_card / (est_card + 1) DESC, query_id LIMIT 1"))
def _best_underestimate(spark, d):
    return _rounded(rp.best_case(_results(spark, d)).select("query_id", "error"), "error")


@_query(_res("SELECT query_id, max(p) AS p_error FROM (SELECT query_id, p_error AS p FROM r WHERE query_id % 2 = 0 UNION ALL SELECT query_id, p_error * 1.5::DOUBLE FROM r WHERE query_id % 3 = 0) GROUP BY query_id ORDER BY 2 DESC, 1 LIMIT 100"))
def _round_cache(spark, d):
    """The 100 best cases of two rounds of exploration; a round has the queries it found."""
    first = _results(spark, d).where("query_id % 2 = 0")
    return rp.merged_round(first, _results(spark, d).where("query_id % 3 = 0").withColumn("p_error", F.col("p_error") * 1.5))


@_query(_res("SELECT method, round(quantile_cont(p_error, 0.9), 6) AS p90, round(median(p_error), 6) AS p50, min(p_error) AS p0 FROM r GROUP BY method"))
def _exact_quantiles(spark, d):
    out = rp.exact_quantiles(_results(spark, d), ["method"], "p_error", {"p90": 0.9, "p50": 0.5, "p0": 0.0})
    return _rounded(out, "p90", "p50")
