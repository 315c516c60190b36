"""Optimizer invariants, plan texts, generators and searchers."""

import itertools

import numpy as np
import pytest

from planscope.catalog import SHOP
from planscope.meta import QueryMeta
from planscope.plans import optimizer as o
from planscope.plans import search as se
from planscope.plans import workload as w

TABLES = ["customer", "orders", "lineitem", "part", "supplier"]
ALIASES = tuple(sorted(SHOP.aliases[t] for t in TABLES))
CONNECTED = o.connected_in(SHOP)
BINS = {("c", "c_acctbal"): [0, 10, 20, 40], ("o", "o_totalprice"): [0, 5, 9], ("l", "l_quantity"): [0, 1, 2, 3, 4], ("p", "p_size"): [0, 7, 9]}


def cards(seed):
    rng = np.random.default_rng(seed)
    return {k: float(rng.integers(1, 10**6)) for k in SHOP.sub_joins(TABLES, 1)}


def all_plans(aliases):
    if len(aliases) == 1:
        yield aliases[0]
    for k in range(1, len(aliases)):
        for left in itertools.combinations(aliases, k):
            right = tuple(a for a in aliases if a not in left)
            if CONNECTED(left) and CONNECTED(right):
                yield from itertools.product(all_plans(left), all_plans(right))


@pytest.mark.parametrize("seed", range(5))
def test_no_plan_is_cheaper_and_p_error_is_at_least_one(seed):
    true, est = cards(seed), cards(seed + 100)
    plan, c = o.best_plan(ALIASES, true, CONNECTED)
    assert c == pytest.approx(o.cost(plan, true)) and c <= min(o.cost(p, true) for p in all_plans(ALIASES)) * (1 + 1e-12)
    assert o.p_error(ALIASES, true, est, CONNECTED)["p_error"] >= 1
    assert o.p_error(ALIASES, true, true, CONNECTED)["p_error"] == 1
    assert o.node_costs(plan, true)[ALIASES]["cost"] == pytest.approx(c)


def test_plan_texts():
    p = o.parse_leading("Leading((a b) (c d))")
    assert p == (("a", "b"), ("c", "d")) and o.is_bushy(p) and o.leading(p) == "((a b) (c d))"
    z = ("d", (("b", "a"), "c"))
    assert o.join_order(z) == ["a", "b", "c", "d"] and not o.is_bushy(z)
    assert o.levels(z)[1] == ["d"] and o.compare(z, ((("a", "b"), "c"), "d")) == []
    assert o.compare(p, z) == ["only in the first: c d", "only in the second: a b c"]
    assert o.same_prefix(["a", "b", "c"], ["b", "a", "c"], 2) and not o.same_prefix(["a", "b", "c"], ["c", "a", "b"], 2)
    assert o.common_prefix([["a", "b"], ["a", "c"]]) == ["a"] and o.card_hints({("a", "b"): 0.4}) == ["Rows(a b #1)"]
    with pytest.raises(ValueError):
        o.join_order(p)
    assert o.dot(z).count("->") == 6


def test_a_plan_flips():
    c = {("c",): 10.0, ("o",): 10.0, ("l",): 10.0, ("c", "o"): 10.0, ("l", "o"): 100.0, ("c", "l", "o"): 50.0}
    assert o.flip_factor(("c", "l", "o"), c, ("c", "o"), CONNECTED) is not None


def test_generators_are_seeded_and_aligned():
    a, b = (w.random_workload(SHOP, TABLES[:4], BINS, 20, 7) for _ in range(2))
    assert a == b and len(a) == 20
    for m in a:
        for f in m.filters:
            edges = BINS[f.alias, f.column]
            assert f.lower - 1 in edges and f.upper in edges
    rng = np.random.default_rng(1)
    assert np.prod(w.log_split(100.0, 5, rng)) == pytest.approx(100)
    assert len(w.card_combinations({"a": [1, 2], "b": [3, 4, 5]}, 100, rng)) == 6
    assert len(w.card_combinations({k: list(range(9)) for k in "abcde"}, 50, rng)) == 50
    p = w.Priors(BINS)
    before = p.columns["c"]["c_acctbal"]
    p.feedback(a[0], 5.0)
    assert p.columns["c"]["c_acctbal"] == pytest.approx(before)
    act = w.ActiveSubsets([("a",), ("b",), ("c",)], 2, 1.5, 3)
    act.finish_round({("a",): 1.0, ("b",): 9.0})
    assert list(act.active) == [("b",), ("c",)]


def evaluate(metas):
    return [1.0 + sum(f.upper - f.lower for f in m.filters) / 10 + len(m.tables) for m in metas]


def test_searchers():
    rng = np.random.default_rng(2)
    tree = se.SearchTree(QueryMeta(("orders",)), SHOP, BINS, evaluate, rng, max_tables=3)
    forest = se.Forest([tree, se.SearchTree(QueryMeta(("part",)), SHOP, BINS, evaluate, rng, max_tables=2)], policy="ucb")
    best = forest.run(steps=50, width=2)
    assert len(best.tables) == 3 and tree.full() and tree.root.visits == len(tree.root.traverse(lambda n: [n], lambda x: sum(x, []))) - 1
    assert se.random_search(TABLES[:2], SHOP, BINS, evaluate, 10, 1)[0][1] >= se.random_search(TABLES[:2], SHOP, BINS, evaluate, 10, 1)[-1][1]
    assert len(se.heuristic_search(TABLES[:2], SHOP, BINS, evaluate, evaluate, 10, 3, 1)) == 3
    assert len(se.feedback_search(TABLES[:2], SHOP, BINS, evaluate, 2, 5, 1)) == 10
    assert se.schedule({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == [["a", "d"], ["b", "c"]]
    assert se.distant_selection([1, 2, 9, 10], lambda x: x, lambda a, b: abs(a - b), 5, 3) == [10, 2]
    assert se.task_decisions({"a": 2, "b": 0, "c": 0}, [1, 1], {"c": 3}) == {"a": "run", "b": "pause", "c": "stop"}
    assert sum(se.template_weights({"a": 3, "b": 2}, {"a": 1, "b": 1}).values()) == pytest.approx(1)
    x, y = se.bayesian_search(1, lambda p: 1 - (p[:, 0] - 0.3) ** 2, np.random.default_rng(0), initial=10, rounds=5)
    assert abs(x[0] - 0.3) < 0.1 and y > 0.98
    mean, dev = se.expected_p_error(lambda r: {"x": r.random()}, lambda c: 1 + c["x"], 200, rng)
    assert 1.3 < mean < 1.7 and dev < 0.5
