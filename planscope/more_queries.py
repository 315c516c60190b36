"""More queries of the catalog: set operations, exploration aggregates, completion and translation."""

from __future__ import annotations

from pyspark.sql import functions as F

from planscope.catalog import SHOP
from planscope.catalog_queries import (
    _CARDS, _LATTICE, _MARGINAL, _RES, BINS, INT, R, _bin_sql, _cards, _marginal, _query, _res, _results, _rounded, _t,
)
from planscope.functions import metrics as mx
from planscope.meta import QueryMeta, to_sql
from planscope.operators import cards as cd
from planscope.operators import cube as cb
from planscope.operators import exploration as ex
from planscope.operators import relation as rl
from planscope.operators import reports as rp
from planscope.streaming import results as st

_ORDERS = "SELECT [['c', 'o', 'l'], ['o', 'c', 'l'], ['l', 'o', 'c'], ['l', 'p', 'o'], ['c', 'o']][CAST(1 + o_orderkey % 5 AS INTEGER)] AS ord, o_orderkey AS k FROM orders"


def _join_orders(spark, d):
    options = F.array(*[F.array(*map(F.lit, x)) for x in (["c", "o", "l"], ["o", "c", "l"], ["l", "o", "c"], ["l", "p", "o"], ["c", "o"])])
    return _t(spark, d, "orders").select(F.element_at(options, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("order"), F.col("o_orderkey").alias("k"))


@_query(f"SELECT alias, CAST(pos - 1 AS INTEGER) AS position, count(*) AS n FROM (SELECT unnest(ord) AS alias, unnest(range(1, len(ord) + 1)) AS pos FROM ({_ORDERS})) GROUP BY 1, 2")
def _join_position_histogram(spark, d):
    return ex.position_histogram(_join_orders(spark, d))


@_query(f"SELECT list_sort(ord[1:2]) AS tables, count(*) AS n FROM ({_ORDERS}) GROUP BY 1 ORDER BY n DESC, tables LIMIT 3")
def _leading_table_sets(spark, d):
    return ex.leading_sets(_join_orders(spark, d), 2, 3)


@_query(f"SELECT ord[2] AS step, count(*) AS n FROM ({_ORDERS}) WHERE ord[1] = 'l' GROUP BY 1")
def _prefix_next_steps(spark, d):
    return ex.next_steps(_join_orders(spark, d), ["l"])


@_query(f"SELECT count(*) FILTER (list_sort(ord[1:2]) = ['c', 'o'] AND ord[3:] = ['l']) AS same FROM ({_ORDERS})")
def _join_order_match(spark, d):
    want = F.array(F.lit("o"), F.lit("c"), F.lit("l"))
    return _join_orders(spark, d).agg(F.count_if(ex.same_order(F.col("order"), want, 2)).alias("same"))


_STATUS = "CASE WHEN query_id % 9 = 0 THEN 'invalid_extension' WHEN p_error < 1 + 1e-7 THEN 'valid' ELSE 'effective' END"


@_query(_res(f"SELECT method, count(*) AS n, round(avg(p_error), 6) AS mean_p_error, max(p_error) AS max_p_error, min(p_error) AS min_p_error, round(median(p_error), 6) AS median_p_error, count(*) FILTER (status = 'effective') AS effective, count(*) FILTER (status = 'valid') AS valid FROM (SELECT *, {_STATUS} AS status FROM r) GROUP BY method"))
def _exploration_summary(spark, d):
    rows = _results(spark, d).withColumn("status", mx.case_status(F.col("query_id") % 9 != 0, F.col("p_error")))
    return _rounded(ex.summary(rows, ["method"]), "mean_p_error", "median_p_error")


@_query(_res("SELECT method, max(CASE WHEN query_id % 4 <> 0 THEN p_error ELSE 10 END) AS benefit FROM r GROUP BY method"))
def _max_inferred_benefit(spark, d):
    return ex.best_path(_results(spark, d).select("method", F.col("p_error").alias("benefit"), (F.col("query_id") % 4 != 0).alias("extendable")), ["method"])


@_query(_res("SELECT method, coalesce(max(p_error) FILTER (query_id % 3 = 0), -1) AS candidate, round(coalesce(avg(p_error) FILTER (query_id % 3 = 1), 0), 6) AS finished FROM r GROUP BY method"))
def _tree_benefits(spark, d):
    state = F.element_at(F.array(F.lit("candidate"), F.lit("finished"), F.lit("open")), (F.col("query_id") % 3 + 1).cast("int"))
    return _rounded(ex.tree_benefits(_results(spark, d).select("method", F.col("p_error").alias("benefit"), state.alias("state")), ["method"]), "finished")


@_query(_res("SELECT t, best, cases FROM (SELECT list_sort(tables) AS t, max(p_error) AS best, count(*) AS cases FROM r GROUP BY 1) WHERE best >= greatest((SELECT b FROM (SELECT max(p_error) AS b, row_number() OVER (ORDER BY max(p_error) DESC) AS i FROM r GROUP BY list_sort(tables)) WHERE i = 3), (SELECT min(p_error) FROM (SELECT p_error FROM r ORDER BY p_error DESC LIMIT 40))) AND cases >= 5"))
def _high_templates(spark, d):
    return ex.high_templates(_results(spark, d).withColumn("t", F.array_sort("tables")), ["t"], 3, 40)


@_query(_res("SELECT query_id, round(greatest((true_card + 1.0::DOUBLE) / (est_card + 1.0::DOUBLE), (est_card + 1.0::DOUBLE) / (true_card + 1.0::DOUBLE)), 6) AS q_old, round(CASE WHEN p_error > 10 THEN greatest((true_card + 1.0::DOUBLE) / (2.0::DOUBLE * est_card + 1.0::DOUBLE), (2.0::DOUBLE * est_card + 1.0::DOUBLE) / (true_card + 1.0::DOUBLE)) ELSE 1 END, 6) AS q_new FROM r"))
def _card_update_errors(spark, d):
    r = _results(spark, d)
    new = r.where("p_error > 10").select("query_id", (F.col("est_card") * 2).alias("new"))
    out = ex.update_errors(r.select("query_id", F.col("true_card").alias("card")), r.select("query_id", F.col("est_card").alias("old")), new, ["query_id"])
    return _rounded(out, "q_old", "q_new")


_OVER = "SELECT est_card / (true_card + 1) AS error FROM r WHERE est_card / (true_card + 1) > 1"


@_query(_res(f"SELECT round(max(error), 6) AS worst, round(quantile_cont(error, 0.9), 6) AS p90, round(median(error), 6) AS median, round((SELECT min(error) FROM (SELECT error FROM ({_OVER}) ORDER BY error DESC LIMIT 5)), 6) AS fifth FROM ({_OVER})"))
def _one_sided_error_report(spark, d):
    errors = _results(spark, d).select(mx.over_error(F.col("true_card"), F.col("est_card")).alias("error"))
    return _rounded(ex.error_report(errors)[0], "worst", "p90", "median", "fifth")


@_query(_res(f"SELECT CAST(floor(log10(error) * 2) AS BIGINT) AS bin, count(*) AS n FROM ({_OVER}) GROUP BY 1"))
def _log_error_histogram(spark, d):
    return ex.error_report(_results(spark, d).select(mx.over_error(F.col("true_card"), F.col("est_card")).alias("error")))[1]


@_query(_res("SELECT query_id, [CAST(list_contains(tables, x) AS INTEGER) FOR x IN ['orders', 't0', 't1', 't2']] AS encoded FROM r"))
def _one_hot_tables(spark, d):
    return _results(spark, d).select("query_id", ex.one_hot(F.col("tables"), ["orders", "t0", "t1", "t2"]).alias("encoded"))


@_query(_res("SELECT query_id, round(ln(true_card / est_card), 9) AS label, true_card::DOUBLE AS restored FROM r"))
def _label_restore(spark, d):
    lab = mx.label(F.col("true_card").cast("double"), F.col("est_card").cast("double"))
    return _results(spark, d).select("query_id", F.round(lab, 9).alias("label"), F.round(mx.restored(F.col("est_card"), lab), 6).alias("restored"))


@_query(_res("SELECT query_id, abs(true_card - est_card)::DOUBLE + abs(elapsed - 100)::DOUBLE AS l1, round(sqrt((true_card - est_card)::DOUBLE ** 2 + (elapsed - 100)::DOUBLE ** 2), 6) AS l2, greatest(abs(true_card - est_card), abs(elapsed - 100))::DOUBLE AS linf FROM r"))
def _meta_distances(spark, d):
    pairs = [(F.col("true_card"), F.col("est_card")), (F.col("elapsed"), F.lit(100))]
    return _results(spark, d).select("query_id", mx.meta_distance(pairs).alias("l1"), F.round(mx.meta_distance(pairs, "l2"), 6).alias("l2"), mx.meta_distance(pairs, "max").alias("linf"))


@_query(_res("SELECT query_id, list_sort(list_distinct(list_concat(tables, columns))) AS both, list_sort(list_filter(tables, x -> x <> 'orders')) AS without, list_contains(tables, 't1') AS has FROM r").replace("x -> x", "lambda x: x"))
def _meta_set_operations(spark, d):
    return _results(spark, d).select("query_id", F.array_sort(F.array_union("tables", "columns")).alias("both"), F.array_sort(F.array_except("tables", F.array(F.lit("orders")))).alias("without"), F.array_contains("tables", "t1").alias("has"))


@_query(_res("SELECT query_id, '(' || array_to_string(list_sort(tables), ',') || '),' || elapsed || '<=' || columns[1] || '<=' || true_card AS meta FROM r"))
def _canonical_meta_text(spark, d):
    text = F.concat(F.lit("("), F.array_join(F.array_sort("tables"), ","), F.lit("),"), F.col("elapsed"), F.lit("<="), F.get("columns", F.lit(0)), F.lit("<="), F.col("true_card"))
    return _results(spark, d).select("query_id", text.alias("meta"))


@_query(_res("SELECT DISTINCT list_sort(tables) AS tables, list_sort(columns) AS columns FROM r WHERE NOT EXISTS (SELECT 1 FROM r z WHERE list_contains(z.tables, 't1') AND list_sort(z.tables) = list_sort(r.tables) AND list_sort(z.columns) = list_sort(r.columns))"))
def _new_templates(spark, d):
    """Templates that none of the existing ones (those with table t1) equals."""
    rows = _results(spark, d).select(*rp.template_key(F.col("tables"), F.col("columns")))
    old = rows.where(F.array_contains("tables", "t1"))
    return rows.select("tables", "columns").distinct().join(old, ["tables", "columns"], "left_anti")


@_query(_res("SELECT count(*) AS n, count(DISTINCT query_id) AS queries FROM (SELECT query_id FROM r WHERE method < '3' UNION ALL SELECT query_id FROM r WHERE p_error > 5)"))
def _workload_union(spark, d):
    r = _results(spark, d)
    both = r.where("method < '3'").select("query_id").unionByName(r.where("p_error > 5").select("query_id"))
    return both.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


@_query(_res("SELECT query_id, p_error FROM r ORDER BY greatest((true_card + 2.0::DOUBLE) / (est_card + 2.0::DOUBLE), (est_card + 2.0::DOUBLE) / (true_card + 2.0::DOUBLE)) DESC, query_id LIMIT 20"))
def _greedy_candidates(spark, d):
    q = mx.q_error(F.col("true_card"), F.col("est_card"), 2)
    return _results(spark, d).orderBy(q.desc(), "query_id").limit(20).select("query_id", "p_error")


@_query(_res("""SELECT i AS from_over FROM (SELECT a.k AS i, abs(a.x - b.y) AS gap FROM (SELECT row_number() OVER (ORDER BY median(p_error) DESC, list_sort(tables)) AS k, median(p_error) AS x FROM r GROUP BY list_sort(tables)) a
 JOIN (SELECT row_number() OVER (ORDER BY max(cost_expected) DESC, list_sort(tables)) AS k, max(cost_expected) / 100000 AS y FROM r GROUP BY list_sort(tables)) b ON a.k + b.k = 5) ORDER BY gap, i LIMIT 1"""))
def _template_mix_split(spark, d):
    from pyspark.sql import Window

    rows = _results(spark, d).withColumn("t", F.array_sort("tables"))
    over = rows.groupBy("t").agg(F.percentile("p_error", F.lit(0.5)).alias("score"))
    under = rows.groupBy("t").agg((F.max("cost_expected") / 100000).alias("score"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "t")).cast("long"))
    return rp.mixed_split(ranked(over), ranked(under), 5)


# --- completion and grids ------------------------------------------------------------------------------------------


@_query(f"WITH m AS ({_MARGINAL}) SELECT {BINS['o_totalprice']}[bin]::BIGINT + 1 AS lower, {BINS['o_totalprice']}[bin + 1]::BIGINT AS upper, cnt FROM m")
def _grid_conditions(spark, d):
    return ex.grid_conditions(_marginal(spark, d), BINS["o_totalprice"])


@_query(f"SELECT aliases, round(e * 0.5::DOUBLE, 6) AS low, round(e * 0.5::DOUBLE * pow(4.0::DOUBLE, 0.5::DOUBLE), 6) AS middle, round(e * 2.0::DOUBLE, 6) AS high FROM ({_CARDS})")
def _scale_candidates(spark, d):
    c = cd.scale_candidates(F.col("est").cast("double"), 3)
    return _cards(spark).select("aliases", F.round(F.get(c, F.lit(0)), 6).alias("low"), F.round(F.get(c, F.lit(1)), 6).alias("middle"), F.round(F.get(c, F.lit(2)), 6).alias("high"))


@_query(f"SELECT aliases, step, CASE WHEN list_contains(aliases, 'o') THEN e * (step + 1) / 4.0::DOUBLE ELSE e::DOUBLE END AS card FROM ({_CARDS}), range(0, 4) s(step)")
def _card_grid_by_factor(spark, d):
    """Every card that touches one table, scaled by evenly spaced factors."""
    steps = _cards(spark).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    card = F.when(F.array_contains("aliases", "o"), F.col("est") * (F.col("step") + 1) / F.lit(4.0)).otherwise(F.col("est").cast("double"))
    return steps.select("aliases", "step", card.alias("card"))


@_query("""WITH k(col, klo, khi, km, card) AS (VALUES ('x', 0, 10, 100, 1000), ('x', 20, 40, 50, 90), ('y', 0, 5, 10, 7)),
 a AS (SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 2 = 0 THEN 'x' ELSE 'y' END AS col, o_orderkey % 30 AS lo, o_orderkey % 30 + o_custkey % 9 AS hi, 1 + o_orderkey % 77 AS m FROM orders),
 b AS (SELECT query_id, card, km, m, row_number() OVER (PARTITION BY query_id ORDER BY abs(lo - klo) + abs(hi - khi), klo, khi) AS i FROM a JOIN k ON a.col = k.col)
 SELECT query_id, round(card * (m::DOUBLE / km), 6) AS estimate FROM b WHERE i = 1""")
def _predicate_transfer(spark, d):
    known = spark.createDataFrame([("x", 0, 10, 100, 1000), ("x", 20, 40, 50, 90), ("y", 0, 5, 10, 7)], "column string, lo long, hi long, marginal long, card long")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = _t(spark, d, "orders").select(k.alias("query_id"), F.when(c % 2 == 0, "x").otherwise("y").alias("column"), (k % 30).alias("lo"), (k % 30 + c % 9).alias("hi"), (k % 77 + 1).alias("marginal"))
    return _rounded(cd.transferred(known, asked), "estimate")


@_query(f"SELECT o_orderkey, {_bin_sql('o_totalprice', BINS['o_totalprice'])} AS bin, {BINS['o_totalprice']}[{_bin_sql('o_totalprice', BINS['o_totalprice'])}]::BIGINT + 1 AS lower FROM orders")
def _range_join_bins(spark, d):
    bins = BINS["o_totalprice"]
    b = cb.bin_index(rl.as_integer(F.col("o_totalprice")), bins)
    return _t(spark, d, "orders").select("o_orderkey", b.alias("bin"), (F.element_at(F.array(*[F.lit(x).cast("long") for x in bins]), b) + 1).alias("lower"))


_STEPS = [(100_000, 120_000), (90_000, 160_000), (50_000, 250_000), (0, 500_000)]


@_query(f"""SELECT CAST(max(step) AS INTEGER) AS step, CAST(max(n) AS BIGINT) AS cardinality FROM (SELECT step, n FROM ({' UNION ALL '.join(f"SELECT {i} AS step, ({to_sql(QueryMeta(('orders', 'customer'), (R('o', 'o_totalprice', *s),)), SHOP, value=INT)}) AS n" for i, s in enumerate(_STEPS))}) WHERE step = 0 OR n <= (SELECT count(*) // 3 FROM orders))""")
def _bounded_join_growth(spark, d):
    """The widest step whose join stays within a third of the orders."""
    tables = rl.parquet_tables(spark, d)
    t = QueryMeta(("orders", "customer"), (R("o", "o_totalprice"),)).template()
    got, step = rl.grow_bounds(t, [{("o", "o_totalprice"): s} for s in _STEPS], tables("orders").count() // 3, SHOP, tables)
    return rl.count_query(got, SHOP, tables).select(F.lit(step).alias("step"), "cardinality")


@_query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def _not_null_columns(spark, d):
    return _t(spark, d, "lineitem").na.drop(subset=["l_quantity", "l_discount"]).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@_query(f"SELECT a.aliases AS sub, count(*) AS supersets FROM ({_LATTICE}) a JOIN ({_LATTICE}) b ON list_has_all(b.aliases, a.aliases) AND len(b.aliases) > len(a.aliases) GROUP BY 1")
def _lattice_containment(spark, d):
    return cd.containment(cd.lattice(spark, SHOP, ["customer", "orders", "lineitem", "part"])).groupBy("sub").agg(F.count("*").alias("supersets"))


@_query("SELECT CAST(o_orderkey % 10 AS BIGINT) AS rank, median(o_totalprice) AS middle FROM orders GROUP BY 1")
def _median_reward(spark, d):
    return _t(spark, d, "orders").groupBy((F.col("o_orderkey") % 10).cast("long").alias("rank")).agg(F.coalesce(F.median("o_totalprice"), F.lit(0.0)).alias("middle"))


# --- the same computations as streams ------------------------------------------------------------------------------


def _drained(spark, stream, mode: str):
    """All that a stream has to say about the files that are there now, by way of the cluster's shared folder."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{shared or tempfile.gettempdir()}/stream_{uuid.uuid4().hex}"

    def keep(batch, epoch):  # a repeated batch writes the same folder again
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/epoch={epoch}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def _event_stream(spark, d):
    return spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/event*.parquet")


@_query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1, 2")
def _stream_windows_live(spark, d):
    """Tumbling windows kept by a running stream (update by trigger, complete output)."""
    out = st.windowed(_event_stream(spark, d), "1 day", "1 day")
    return _drained(spark, out, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("SELECT event_id, event_type FROM events")
def _stream_without_repeats_live(spark, d):
    """Results that arrive twice count once: the stream is unioned with itself."""
    rows = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(spark, st.without_repeats(rows.union(rows), ["event_id"], "60 days").select("event_id", "event_type"), "append")
