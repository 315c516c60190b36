"""Catalog and meta: classes, connected sets, SQL in and out."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from planscope.catalog import SHOP, load_catalog
from planscope.meta import PLACEHOLDER, QueryMeta, RangeFilter, join_conditions, parse_sql, to_sql

R = RangeFilter


def test_siblings_join_directly():
    assert SHOP.join_pairs(["orders"], "events") == [("orders", "o_custkey", "events", "user_id")]
    assert SHOP.neighbours(["supplier"]) == ["lineitem", "nation"]
    assert SHOP.connected(["orders", "events"]) and not SHOP.connected(["part", "region"])


def test_sub_joins():
    assert SHOP.sub_joins(["customer", "orders", "lineitem"]) == [("c", "o"), ("l", "o"), ("c", "l", "o")]
    assert SHOP.join_order(["region", "nation", "supplier"]) == ["region", "nation", "supplier"]
    with pytest.raises(ValueError):
        SHOP.join_order(["region", "part"])


def test_metas_are_canonical():
    a = QueryMeta(("orders", "customer", "orders"), (R("o", "x", "5", None), R("o", "x", 5, None)))
    assert a == QueryMeta(("customer", "orders"), (R("o", "x", 5, None),)) and hash(a) == hash(QueryMeta(("customer", "orders"), (R("o", "x", 5),)))
    assert a.text(SHOP) == "(c,o),5<=o.x"
    t = a.template()
    assert t.filters[0].lower == PLACEHOLDER and t.filled({("o", "x"): (5, None)}) == a
    assert a.union(QueryMeta(("part",))).contains(a) and a.intersection(QueryMeta(("part",))) == QueryMeta(())
    assert a.restricted(["o"], SHOP) == QueryMeta(("orders",), a.filters)


bound = s.one_of(s.none(), s.integers(-1000, 1000))


@settings(max_examples=200, deadline=None)
@given(s.sampled_from(SHOP.sub_joins(["customer", "orders", "lineitem", "events"], 1)), s.lists(s.tuples(bound, bound), min_size=4, max_size=4))
def test_sql_round_trip(aliases, bounds):
    cols = {"c": "c_acctbal", "o": "o_totalprice", "l": "l_quantity", "e": "value"}
    m = QueryMeta(tuple(SHOP.tables_by_alias[a] for a in aliases), tuple(R(a, cols[a], *b) for a, b in zip(aliases, bounds, strict=False)))
    assert parse_sql(to_sql(m, SHOP), SHOP) == m


def test_parser():
    m = parse_sql("select count(*)  from orders x, customer AS c WHERE x.o_custkey = c.c_custkey AND x.o_totalprice > 5 and x.o_totalprice < 9 AND TRUE;", SHOP)
    assert m == QueryMeta(("orders", "customer"), (R("o", "o_totalprice", 6, 8),))
    for bad in ("select 1", "select * from orders o where o.a != 3", "select * from orders o, part p where o.o_custkey = p.p_partkey", "select * from nothing", "select * from orders o where o.a = 1 or o.b = 2"):
        with pytest.raises((ValueError, KeyError)):
            parse_sql(bad, SHOP)


def test_primary_key_table_is_added():
    m = QueryMeta(("orders", "events"))
    assert join_conditions(m, SHOP) == ["e.user_id = o.o_custkey"]
    assert "customer AS c" in to_sql(m, SHOP, via_keys=True) and "customer" not in to_sql(QueryMeta(("orders", "lineitem")), SHOP, via_keys=True)


def test_catalog_file(tmp_path):
    head = {"all_columns": {"a": ["id", "x"], "b": ["aid", "t"], "z": ["q"]}, "primary_keys": {"a": "id"}, "column_types": {"a": [["id", "integer"], ["x", "integer"]], "b": [["aid", "integer"], ["t", "character varying"]]},
            "foreign_keys": {"b": [["aid", "a", "id"]]}, "table_spec": ["a", "b"], "column_spec": {}}
    (tmp_path / "header.json").write_text(json.dumps(head))
    c = load_catalog(str(tmp_path / "header.json"), {"a": "al", "b": "al_b", "z": "z"})
    assert sorted(c.aliases) == ["a", "b"] and c.connected(["a", "b"])
    assert c.valid_columns("a", {}) == ["x"] and c.valid_columns("a", {"x": 0.4}) == [] and c.valid_columns("b", {}) == []
    assert c.split_column("al_b_t") == ("al_b", "t") and c.split_column("al_x") == ("al", "x")


def test_growth_is_monotonic():
    from planscope.operators.relation import growth_ladder

    rng = random.Random(1)
    for _ in range(20):
        lo, hi = sorted(rng.sample(range(1000), 2))
        steps = growth_ladder(0, 1000, lo, hi)
        assert steps[-1] == (0, 1000) and all(b[1] - b[0] >= a[1] - a[0] - 1 for a, b in zip(steps, steps[1:], strict=False))
