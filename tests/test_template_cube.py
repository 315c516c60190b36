"""Template cubes against directly counted joins on small random tables with nulls."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planscope.catalog import Catalog, ForeignKey
from planscope.functions import estimators as es
from planscope.meta import QueryMeta, RangeFilter
from planscope.operators import cards as cd
from planscope.operators import cube as cb
from planscope.operators import relation as rl
from planscope.operators import reports as rp
from planscope.operators import template_cube as tc

R = RangeFilter
CAT = Catalog({"hub": "h", "left": "a", "right": "b"}, {"hub": "id"}, (ForeignKey("left", "hid", "hub", "id"), ForeignKey("right", "hid", "hub", "id")), {"hub": ("v",), "left": ("x",), "right": ("y",)})
BINS = {("h", "v"): [-3, 0, 2, 4], ("a", "x"): [-1, 5, 12, 30], ("b", "y"): [-1, 2, 3, 9]}
ALL = ("hub", "left", "right")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    maybe = lambda values: rng.choice([None, *values])
    data = {
        "hub": spark.createDataFrame([(i, maybe([-2.5, -0.5, 0.5, 1.9, 3.0])) for i in range(1, 21)], "id int, v double"),
        "left": spark.createDataFrame([(maybe(range(1, 21)), maybe(range(31))) for _ in range(80)], "hid int, x int"),
        "right": spark.createDataFrame([(maybe(range(1, 21)), maybe(range(10))) for _ in range(60)], "hid int, y int"),
    }
    return data.__getitem__


@pytest.mark.parametrize("names", [ALL, ("left", "right"), ("hub", "left"), ("hub",)])
def test_counts_equal_the_built_join(tables, names):
    cube, rng, metas = tc.TemplateCube.build(names, CAT, tables, BINS), random.Random(len(names)), {}
    for i in range(8):
        filters = []
        for (a, c), edges in cube.bins.items():
            if rng.random() < 0.7:
                lo, hi = sorted(rng.choices(range(1, len(edges)), k=2))
                filters.append(R(a, c, rng.choice([None, edges[lo - 1] + 1]), rng.choice([None, edges[hi]])))
        metas[str(i)] = QueryMeta(names, tuple(filters))
    got = {r.query_id: r.cardinality for r in cube.counts(metas).collect()}
    assert got == {n: rl.relation(m, CAT, tables).count() for n, m in metas.items()}


def test_bounds_that_are_no_edges(tables):
    cube = tc.TemplateCube.build(ALL, CAT, tables, BINS)
    odd = {"odd": QueryMeta(ALL, (R("a", "x", 4, 12),)), "even": QueryMeta(ALL, (R("a", "x", 6, 12),))}
    with pytest.raises(ValueError):
        cube.counts(odd)
    assert cube.region_of(QueryMeta(("hub",))) is None
    got = {r.query_id: r.cardinality for r in cube.counts_or_direct(odd, CAT, tables).collect()}
    assert got == {n: rl.relation(m, CAT, tables).count() for n, m in odd.items()}


def test_all_parts_of_a_query(tables):
    metas = {"q": QueryMeta(ALL, (R("h", "v", -2, 2), R("b", "y", 3, None)))}
    got = {tuple(r.aliases): r.cardinality for r in tc.plan_cards(tc.sub_join_cubes(ALL, CAT, tables, BINS), metas, CAT).collect()}
    assert got == {k: rl.relation(metas["q"].restricted(k, CAT), CAT, tables).count() for k in CAT.sub_joins(ALL, 1)}


def test_joins_with_a_cycle(spark):
    cat = Catalog({"a": "a", "b": "b", "c": "c"}, {}, (ForeignKey("a", "x", "b", "x"), ForeignKey("b", "y", "c", "y"), ForeignKey("c", "z", "a", "z")))
    data = {"a": spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "x int, z int"), "b": spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "x int, y int"), "c": spark.createDataFrame([(5, 1), (5, 2), (6, 9)], "y int, z int")}
    cells = tc.join_cells(("a", "b", "c"), cat, data.__getitem__, {("a", "x"): [0, 1, 2]})
    assert {(r.bin_a_x, r.cnt) for r in cells.collect()} == {(1, 2), (2, 1)}


def test_regions_cells_and_draws(tables):
    cube = tc.TemplateCube.build(("left", "right"), CAT, tables, BINS)
    regions = tc.random_regions(cube, 12, seed=4)
    assert sorted(map(tuple, regions.collect())) == sorted(map(tuple, tc.random_regions(cube, 12, seed=4).repartition(3).collect()))
    labels = cube.region_labels(regions).collect()
    assert len(labels) == 12
    for r in labels:
        m = QueryMeta(("left", "right"), (R("a", "x", r.lower_a_x, r.upper_a_x), R("b", "y", r.lower_b_y, r.upper_b_y)))
        assert r.cardinality == rl.relation(m, CAT, tables).count()
    near = tc.regions_near(cube, 0.25, 2, 12, seed=4, relative=True).collect()
    goal = rl.relation(QueryMeta(("left", "right")), CAT, tables).count() / 4
    gaps = sorted(abs(math.log((r.cardinality + 1) / (goal + 1))) for r in labels)
    assert sorted(abs(math.log((r.cardinality + 1) / (goal + 1))) for r in near) == pytest.approx(gaps[:2])
    cells = tc.random_cells(cube.cells, cube.columns, 3, seed=1)
    assert cells.count() == 3 and cells.select("bin_a_x", "bin_b_y").distinct().count() == 3
    one = cube.cell_metas([4])["4"]
    assert one == QueryMeta(("left", "right"), (R("a", "x", 6, 12), R("b", "y", 3, 3)))
    with pytest.raises(ValueError):
        cube.cell_metas([9])
    out = cube.evaluated({"4": one}, es.Fixed({}, 7.0)).first()
    assert out.estimate == 7 and out.cardinality == rl.relation(one, CAT, tables).count() and out.q_error >= 1


def test_budgets_and_marginals(spark, tables):
    assert [tc.root_budget(b, n) for b, n in ((100, 2), (101, 2), (27, 3), (1, 4), (5, 1))] == [10, 11, 3, 1, 5]
    assert tc.affordable_sets({"a": 4, "b": 5, "c": 10}, ["a"], 100) == [(), ("b",), ("c",)]
    both = tables("left").select("x", F.col("hid").alias("k"))
    bins = {"x": [-1, 5, 12, 30], "k": [0, 10, 20, 40]}
    got = {(r.column, r.bin): r.cnt for r in cb.marginals(both, bins).collect()}
    for c, b in bins.items():
        assert {k: n for (col, k), n in got.items() if col == c} == {r.bin: r.cnt for r in cb.marginal(both, c, b).collect()}
    with pytest.raises(ValueError):
        cb.strict_marginal(both, "k", bins["k"])
    assert cb.strict_marginal(both, "x", bins["x"]).count() == 3
    rows = spark.createDataFrame([(i // 7, i * i % 41) for i in range(70)] + [(99, None)], "g int, v int")
    wide = tc.table_cube("hub", CAT, tables, 1, 3)
    assert list(wide.bins) == [("h", "v")] and wide.cells.agg(F.sum("cnt")).first()[0] == 20
    want = {r.g: (r.a, r.b) for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.3)).alias("a"), F.percentile("v", F.lit(1.0)).alias("b")).where("a is not null").collect()}
    got = {r.g: (pytest.approx(r.a), r.b) for r in rp.exact_quantiles(rows, ["g"], "v", {"a": 0.3, "b": 1.0}).collect()}
    assert got == want


def test_empty_tables(spark):
    none = {"left": spark.createDataFrame([], "hid int, x int"), "right": spark.createDataFrame([], "hid int, y int")}.__getitem__
    cube = tc.TemplateCube.build(("left", "right"), CAT, none, BINS)
    assert cube.cells.count() == 0 and cube.counts({"q": QueryMeta(("left", "right"))}).first().cardinality == 0
    assert cb.bin_boundaries(none("left"), "x", 4).count() == 0
    assert rl.count_query(QueryMeta(("left", "right")), CAT, none).first()[0] == 0


def test_card_intersection_and_rounds(spark):
    a = spark.createDataFrame([("q", ["a"], 1, None), ("q", ["b"], 2, 3)], "query_id string, aliases array<string>, true long, est long")
    b = spark.createDataFrame([("q", ["a"], 1, None), ("q", ["b"], 2, 4)], "query_id string, aliases array<string>, true long, est long")
    assert [r.aliases for r in cd.intersection(a, b).collect()] == [["a"]]
    x = spark.createDataFrame([(1, 5.0), (2, 3.0)], "query_id int, p_error double")
    y = spark.createDataFrame([(2, 9.0), (3, None)], "query_id int, p_error double")
    assert [(r.query_id, r.p_error) for r in rp.merged_round(x, y, 2).collect()] == [(2, 9.0), (1, 5.0)]
