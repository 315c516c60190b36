"""Relations, cubes, cards, estimators, files and streams on small tables."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from planscope.catalog import Catalog, ForeignKey
from planscope.functions import estimators as es
from planscope.functions import metrics as mx
from planscope.meta import QueryMeta, RangeFilter
from planscope.operators import cards as cd
from planscope.operators import cube as cb
from planscope.operators import relation as rl
from planscope.operators import reports as rp
from planscope.sources import files
from planscope.streaming import results as st

R = RangeFilter
CAT = Catalog({"hub": "h", "left": "a", "right": "b"}, {"hub": "id"}, (ForeignKey("left", "hid", "hub", "id"), ForeignKey("right", "hid", "hub", "id")), {"hub": ("v",), "left": ("x",), "right": ("y",)})


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, *range(1, 21)])
    data = {
        "hub": spark.createDataFrame([(i, float(i % 7) - 2.5) for i in range(1, 21)], "id int, v double"),
        "left": spark.createDataFrame([(pick(), rng.randint(0, 30)) for _ in range(80)], "hid int, x int"),
        "right": spark.createDataFrame([(pick(), rng.choice([None, *range(10)])) for _ in range(60)], "hid int, y int"),
    }
    return data.__getitem__


def test_null_keys_and_values_never_match(tables):
    m = QueryMeta(("left", "right"), (R("b", "y", None, None),))
    a, b = tables("left").collect(), tables("right").collect()
    assert rl.count_query(m, CAT, tables).first()[0] == sum(x.hid == y.hid and x.hid is not None and y.y is not None for x in a for y in b)


def test_batch_equals_single_counts(tables):
    metas = {"1": QueryMeta(("left",), (R("a", "x", 3, 9),)), "2": QueryMeta(("left", "hub"), (R("h", "v", 0, 2),)), "3": QueryMeta(("left", "hub")), "4": QueryMeta(("left", "right", "hub"), (R("b", "y", 5, None), R("a", "x", None, 20)))}
    got = {r.query_id: r.cardinality for r in rl.count_batch(metas, CAT, tables).collect()}
    assert got == {k: rl.count_query(m, CAT, tables).first()[0] for k, m in metas.items()}
    assert es.Exact(CAT, tables).estimate(list(metas.values())) == list(map(float, got.values()))


@pytest.mark.parametrize("kind", ["double", "int", "decimal(6,2)"])
def test_predicates_cut_toward_zero(spark, kind):
    df = spark.createDataFrame([(None if i == 41 else i / 4,) for i in range(-40, 42)], "x double").select(F.col("x").cast(kind).alias("t_x"))
    values = [None if r.t_x is None else int(r.t_x) for r in df.collect()]
    for lo, hi in [(None, None), (-3, None), (0, None), (2, None), (None, -2), (None, 0), (None, 3), (-1, 1), (0, 0), (-2, -2), (5, 4)]:
        want = sum(v is not None and (lo is None or v >= lo) and (hi is None or v <= hi) for v in values)
        assert rl.apply_filters(df, [R("t", "x", lo, hi)]).count() == want, (lo, hi)


def test_counts_equal_the_built_join(tables):
    rng = random.Random(8)
    side = lambda a, c: R(a, c, rng.choice([None, rng.randint(-3, 8)]), rng.choice([None, rng.randint(2, 20)]))
    for names in (("left", "right"), ("left", "right", "hub"), ("hub", "right"), ("hub",)):
        cols = [(CAT.aliases[t], CAT.predicate_columns[t][0]) for t in names]
        metas = {str(i): QueryMeta(names, tuple(side(*c) for c in cols if rng.random() < 0.7 or i < 2)) for i in range(5)}
        got = {r.query_id: r.cardinality for r in rl.count_batch(metas, CAT, tables).collect()}
        assert got == {k: rl.relation(m, CAT, tables).count() for k, m in metas.items()}


def test_joins_with_a_cycle_are_built(spark):
    cat = Catalog({"a": "a", "b": "b", "c": "c"}, {}, (ForeignKey("a", "x", "b", "x"), ForeignKey("b", "y", "c", "y"), ForeignKey("c", "z", "a", "z")))
    data = {"a": spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "x int, z int"), "b": spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "x int, y int"), "c": spark.createDataFrame([(5, 1), (5, 2), (6, 9)], "y int, z int")}
    assert rl.JoinTree.of(("a", "b", "c"), cat) is None
    assert rl.count_query(QueryMeta(("a", "b", "c")), cat, data.__getitem__).first()[0] == 3


def test_hull_of_filters():
    a = QueryMeta(("left",), (R("a", "x", 3, 9), R("a", "x", 1, 7)))
    b = QueryMeta(("left",), (R("a", "x", 5, None), R("a", "y", 1, 1)))
    assert rl.hull([a, b]) == (R("a", "x", 3, None),) and rl.hull([a]) == (R("a", "x", 3, 7),) and rl.hull([a, QueryMeta(("left",))]) == ()


def test_filters_reach_the_scan_and_no_repeated_keys_are_joined(spark, tmp_path, tables):
    for n in ("left", "right", "hub"):
        tables(n).write.parquet(f"{tmp_path}/{n}.parquet")
    stored = rl.parquet_tables(spark, str(tmp_path))
    metas = {"1": QueryMeta(("left", "right"), (R("a", "x", 3, 9),)), "2": QueryMeta(("left", "right"), (R("a", "x", 5, 12), R("b", "y", 1, 2)))}
    text = rl.count_batch(metas, CAT, stored)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(x,3)" in text and "LessThan(x,13)" in text
    # both sides repeat the key: the one below the root is grouped before the join
    logical = rl.count_batch(metas, CAT, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [hid" in logical.replace("a_hid", "hid").replace("b_hid", "hid").split("Join", 1)[1]
    assert "GreaterThan(v,-1.0)" in rl.apply_filters(rl.prefixed(stored("hub"), "h"), [R("h", "v", 0, None)])._jdf.queryExecution().toString()


def test_cube_slices_equal_direct_counts(spark, tables):
    rel = rl.relation(QueryMeta(("left", "right")), CAT, tables, ["a_x", "b_y"])
    bins = {"a_x": [-1, 5, 12, 30], "b_y": [-1, 2, 3, 9]}
    cells, rng = cb.cube(rel, bins), random.Random(2)
    picks = [(str(i), *sorted(rng.choices(range(1, 4), k=2)), *sorted(rng.choices(range(1, 4), k=2))) for i in range(8)]
    ranges = spark.createDataFrame(picks, "query_id string, lo_a_x int, hi_a_x int, lo_b_y int, hi_b_y int")
    got = {r.query_id: r.cardinality for r in cb.slice_batch(cells, ranges, ["a_x", "b_y"]).collect()}
    for q, a, b, c, d in picks:
        assert got[q] == rel.where(F.col("a_x").between(bins["a_x"][a - 1] + 1, bins["a_x"][b]) & F.col("b_y").between(bins["b_y"][c - 1] + 1, bins["b_y"][d])).count()


@pytest.mark.parametrize("values,budget,want", [([1, 1, 2, 3, 5, 8, 13, 21], 4, [0, 3, 8, 21]), ([4, 4, 7], 5, [3, 4, 7]), ([None, 9], 3, [8, 9])])
def test_bins(spark, values, budget, want):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert cb.collect_bins(cb.bin_boundaries(df, "v", budget)) == want


def test_bins_by_counts_equal_picked_positions(spark):
    rng = random.Random(5)
    for _ in range(6):
        values = sorted(rng.choices(range(rng.choice([30, 500])), k=rng.randint(40, 300)))
        budget = rng.randint(3, 25)
        if len(set(values)) <= budget:
            continue
        picks = sorted({values[(i * (len(values) - 1)) // budget] for i in range(budget + 1)})
        picks[0] -= 1
        assert cb.collect_bins(cb.bin_boundaries(spark.createDataFrame([(v,) for v in values], "v int"), "v", budget)) == picks


def test_cell_index_round_trip(spark):
    df = spark.range(60).withColumn("flat", F.col("id"))
    a, b, c = cb.multi_index(F.col("flat"), [3, 4, 5])
    assert df.select(a.alias("a"), b.alias("b"), c.alias("c"), "flat").where(cb.flat_index([F.col("a"), F.col("b"), F.col("c")], [3, 4, 5]) != F.col("flat")).count() == 0


def test_completion_fixture(spark):
    cards = spark.createDataFrame([("q", ["a", "b"], 10, 5), ("q", ["a", "b", "c"], None, 20)], "query_id string, aliases array<string>, true long, est long")
    assert cd.ratio_completed(cards).where(F.size("aliases") == 3).first().inferred == 40
    assert cd.missing(cards.select("query_id", "aliases"), cards).count() == 1 and not cd.valid(cards).first().valid


def _transfer_by_hand(known, asked):
    last = lambda x: (x is None, x or 0)
    best = {}
    for q, c, lo, hi, m in asked:
        for kc, klo, khi, km, card in known:
            if c is not None and kc == c:
                near = None if None in (lo, hi, klo, khi) else abs(lo - klo) + abs(hi - khi)
                estimate = None if m is None or card is None or not km else card * (m / km)
                rank = (last(near), last(klo), last(khi), last(km), last(card))
                best[q] = min(best.get(q, (rank, estimate)), (rank, estimate), key=lambda x: x[0])
    return {q: e for q, (_, e) in best.items()}


KNOWN_SCHEMA, ASKED_SCHEMA = ("column string, lo long, hi long, marginal long, card long", "query_id long, column string, lo long, hi long, marginal long")


def test_predicate_transfer_equals_a_loop(spark):
    rng = random.Random(5)
    known = [(rng.choice("xyz"), rng.randint(0, 9), rng.randint(5, 19), rng.randint(0, 4), rng.randint(0, 99)) for _ in range(25)]
    known += [(None, 1, 2, 3, 4), ("x", None, 3, 1, 7), ("only nulls", None, None, 2, 9)]
    number = lambda n: rng.choice([None, *range(n)])
    asked = []
    for q in [None, *range(200)]:  # marginals differ between queries only: rows at equal distance agree
        asked += [(q, rng.choice([None, "x", "y", "z", "only nulls", "unknown"]), number(12), number(20), q) for _ in range(rng.randint(1, 4))]
    got = cd.transferred(spark.createDataFrame(known, KNOWN_SCHEMA), spark.createDataFrame(asked, ASKED_SCHEMA)).collect()
    assert {r.query_id: r.estimate for r in got} == pytest.approx(_transfer_by_hand(known, asked)) and len(got) == len({r.query_id for r in got})


def test_predicate_transfer_puts_ranges_without_a_distance_last(spark):
    known = spark.createDataFrame([("x", 0, 10, 10, 100), ("y", 0, 10, 10, 500)], KNOWN_SCHEMA)
    asked = spark.createDataFrame([(1, "x", None, 10, 10), (1, "y", 3, 30, 10), (2, "x", None, 10, 10)], ASKED_SCHEMA)
    assert {r.query_id: r.estimate for r in cd.transferred(known, asked).collect()} == {1: 500.0, 2: 100.0}


def test_predicate_transfer_deals_rows_by_query(spark, monkeypatch):
    """One column and one query that asks for half of the ranges: tasks stay small, and grow in number with the rows."""
    monkeypatch.setattr(cd, "ROWS_A_TASK", 500, raising=False)
    known = spark.createDataFrame([("x", 0, 10, 100, 1000), ("x", 20, 40, 50, 90)], KNOWN_SCHEMA)
    for n in (4_000, 16_000):
        query = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1)
        asked = spark.range(0, n, 1, 16).select(query.alias("query_id"), F.lit("x").alias("column"), (F.col("id") % 30).alias("lo"), (F.col("id") % 30 + 5).alias("hi"), F.lit(100).alias("marginal"))
        out = cd.transferred(known, asked)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n // 2 + 1 and max(sizes) <= 500
        dealt = re.findall(r"hashpartitioning\((.*?), (\d+)\)", re.sub(r"#\d+L?", "", out._jdf.queryExecution().executedPlan().toString()))
        assert dealt == [("query_id", str(n // 500)), ("query_id, share", str(n // 500))]


def test_metric_fixtures(spark):
    df = spark.createDataFrame([("m", 1, 10.0, 1.0, 5.0), ("m", 2, 4.0, 2.0, 3.0), ("m", 3, 6.0, 6.0, 9.0)], "method string, query_id int, cost_actual double, cost_expected double, p_error double")
    assert rp.cumulative_error(df, 3).first().cumulative == pytest.approx(14 / 3)
    assert rp.element_at_rank(df, ["method"], 1).first().topk == 5 and rp.element_at_rank(df, ["method"], 5).first().topk == 3
    one = spark.createDataFrame([(10, 40)], "t int, e int")
    assert one.select(mx.clipped_benefit(F.col("e"), F.col("t"), 10)).first()[0] == pytest.approx(1 / 3)
    assert rp.text_table(df.select("method"), "x").splitlines()[0] == "x" and r"\hline" in rp.latex_table(df)


def test_estimators(tables):
    m = QueryMeta(("left", "hub"), (R("a", "x", 0, 30),))
    e = es.Independence.from_tables(CAT, tables, ["hub", "left", "right"])
    assert e.estimate([QueryMeta(("hub",))]) == [20.0] and e.estimate([m])[0] == pytest.approx(80 * 20 / 20, rel=0.2)
    assert set(e.sub_joins(m, CAT)) == {("a",), ("h",), ("a", "h")}

    class Broken(es.Estimator):
        def estimate(self, metas):
            raise OSError

    asked = []

    class Counting(es.Estimator):
        def estimate(self, metas):
            asked.extend(metas)
            return [1.0] * len(metas)

    r = es.Remembering(es.Chain(Broken(), Counting()))
    assert r.estimate([m, m]) == [1.0, 1.0] and r.estimate([m]) == [1.0] and len(asked) == 1
    assert es.CatalystStats(CAT, tables, es.Fixed({}, 7.0)).estimate([m])[0] > 0


def test_views_and_bounds(spark, tables, tmp_path):
    reg = rl.ViewRegistry(str(tmp_path), CAT, limit=1)
    m = QueryMeta(("left", "hub"))
    assert reg.fetch(spark, m, tables).count() == rl.relation(m, CAT, tables).count() and reg.by_name(spark, m.name(CAT)) is not None
    reg.fetch(spark, QueryMeta(("hub",)), tables)
    assert reg.load(spark, m) is None
    steps = [{("a", "x"): (10, 12)}, {("a", "x"): (5, 20)}, {("a", "x"): (0, 30)}]
    t = QueryMeta(("left",), (R("a", "x"),)).template()
    first = rl.count_query(t.filled(steps[1]), CAT, tables).first()[0]
    got, step = rl.grow_bounds(t, steps, first, CAT, tables)
    assert step == 1 and got == t.filled(steps[1])
    assert rl.counts_with_timeout(spark, {"a": tables("hub"), "b": tables("left")}, 60) == {"a": 20, "b": 80}


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,"a, b"\n2,"c \\"d\\""\n,x\n')
    files.ingest_csv(spark, {"t": str(tmp_path / "t.csv")}, {"t": [("id", "int"), ("s", "string")]}, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/t.parquet").orderBy("id").collect()] == [(None, "x"), (1, "a, b"), (2, 'c "d"')]
    log = spark.createDataFrame([("('a', 'b')#q#12#0.5",), ("a#q#-1#3",), ("broken",)], "value string")
    assert [(r.aliases, r.card, r.subquery) for r in files.async_log(log).collect()] == [(["a", "b"], 12, True), (["a"], None, False)]
    store = files.ResultStore(str(tmp_path / "r"))
    a = store.save(spark.range(3), {"method": "x", "seed": 1})
    b = store.save(spark.range(2), {"seed": 2}, reference=a)
    assert store.find(method="x") == [a, b] and store.load(spark).count() == 2 and store.load(spark, a).count() == 3
    assert files.configurations({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}] and files.read_json("/nowhere.json") == {}
    t = files.card_table(spark, {"q": {"true": {"subquery": {("a", "b"): 5}, "single_table": {"a": 2}}, "estimation": {"subquery": {("b", "a"): 7}}}})
    assert {(tuple(r.aliases), r["true"], r.est) for r in t.collect()} == {(("a", "b"), 5, 7), (("a",), 2, None)}


def test_streams(spark, tmp_path):
    rows = [(f"t{i % 3}", f"k{i // 3}", i, f"2024-01-0{1 + i % 2} 10:00:00", "click", float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "task string, key string, card long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: st.read_results(spark, f"{tmp_path}/in", df.schema)

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    # a query with processing-time timeouts never ends by itself
    q = st.completed_tasks(stream(), 3).writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", f"{tmp_path}/done").start()
    for _ in range(120):
        if spark.table("done").count() == 3:
            break
        time.sleep(0.5)
    q.stop()
    done = spark.table("done")
    assert {(r.task, r.done, r.received) for r in done.collect()} == {(f"t{i}", True, 3) for i in range(3)}
    w = run(st.windowed(stream(), "1 day", "1 second"), "windows", "complete")
    assert sorted(tuple(r) for r in w.collect()) == sorted(tuple(r) for r in st.windowed(df).collect())
    q = stream().writeStream.foreachBatch(st.merge_into(f"{tmp_path}/m", ["task"], "card")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.task: r.card for r in spark.read.parquet(f"{tmp_path}/m/v2").collect()} == {"t0": 6, "t1": 7, "t2": 8}


def test_entry_works_without_the_training_data_part(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 6
