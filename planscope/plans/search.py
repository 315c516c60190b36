"""Searching workloads for queries whose estimates hurt: UCB trees over query extensions, policies, schedules.

The searchers are driver objects; whatever they evaluate goes through a batch evaluator
``evaluate(list[QueryMeta]) -> list[float]`` (p-errors), so one step is one batch of Spark jobs.
"""

from __future__ import annotations

import heapq
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from planscope.catalog import Catalog
from planscope.meta import QueryMeta
from planscope.plans.workload import Bins, Priors, random_query, random_range

Evaluator = Callable[[list[QueryMeta]], list[float]]


def ucb(total: float, visits: int, parent_visits: int, weight: float = 1.0) -> float:
    return math.inf if not visits else total / visits + weight * math.sqrt(math.log(max(1, parent_visits)) / visits)


@dataclass
class Node:
    meta: QueryMeta
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    open: list[str] = field(default_factory=list)
    visits: int = 0
    total: float = 0.0
    error: float = 1.0

    def update(self, benefit: float) -> None:
        node: Node | None = self
        while node:
            node.visits, node.total = node.visits + 1, node.total + benefit
            node = node.parent

    def traverse(self, map_: Callable[[Node], Any], reduce_: Callable[[list], Any]) -> Any:
        return reduce_([map_(self)] + [c.traverse(map_, reduce_) for c in self.children])


class SearchTree:
    """Extends a root query by one table and one range at a time; benefit is the p-error's logarithm."""

    def __init__(self, root: QueryMeta, catalog: Catalog, bins: Bins, evaluate: Evaluator, rng: np.random.Generator, *, max_tables: int = 4, weight: float = 1.0):
        self.catalog, self.bins, self.evaluate, self.rng, self.max_tables, self.weight = catalog, bins, evaluate, rng, max_tables, weight
        self.root = self._node(root, None)

    def _node(self, meta: QueryMeta, parent: Node | None) -> Node:
        nearby = [t for t in self.catalog.neighbours(meta.tables) if any(a == self.catalog.aliases[t] for a, _ in self.bins)]
        return Node(meta, parent, open=nearby if len(meta.tables) < self.max_tables else [])

    def full(self) -> bool:
        return self.root.traverse(lambda n: not n.open, all)

    def select(self) -> Node | None:
        node = self.root
        while not node.open:
            alive = [c for c in node.children if not c.traverse(lambda n: not n.open, all)]
            if not alive:
                return None
            node = max(alive, key=lambda c: ucb(c.total, c.visits, node.visits, self.weight))
        return node

    def expand(self, node: Node) -> Node:
        table = node.open.pop(int(self.rng.integers(len(node.open))))
        alias = self.catalog.aliases[table]
        column = sorted(c for a, c in self.bins if a == alias)[0]
        lo, hi = random_range(self.bins[alias, column], self.rng)
        from planscope.meta import RangeFilter

        child = self._node(node.meta.with_tables(table).with_filters(RangeFilter(alias, column, lo, hi)), node)
        node.children.append(child)
        return child

    def step(self, width: int = 1) -> list[Node]:
        """Expand up to ``width`` nodes and evaluate them in one batch."""
        fresh = []
        for _ in range(width):
            node = self.select()
            if node is None:
                break
            fresh.append(self.expand(node))
        for node, error in zip(fresh, self.evaluate([n.meta for n in fresh]) if fresh else [], strict=True):
            node.error = error
            node.update(math.log(max(1.0, error)))
        return fresh

    def best(self) -> Node:
        return self.root.traverse(lambda n: n, lambda ns: max(ns, key=lambda n: n.error))


class Forest:
    """Several trees; the next one is chosen by epsilon-greedy, polling or UCB."""

    def __init__(self, trees: Sequence[SearchTree], policy: str = "ucb", epsilon: float = 0.2, seed: int = 0):
        self.trees, self.policy, self.epsilon, self.rng, self.turn = list(trees), policy, epsilon, np.random.default_rng(seed), 0

    def choose(self) -> SearchTree | None:
        alive = [t for t in self.trees if not t.full()]
        if not alive:
            return None
        self.turn += 1
        if self.policy == "polling":
            return alive[self.turn % len(alive)]
        if self.policy == "greedy":
            return alive[int(self.rng.integers(len(alive)))] if self.rng.random() < self.epsilon else max(alive, key=lambda t: t.best().error)
        return max(alive, key=lambda t: ucb(t.root.total, t.root.visits, self.turn))

    def run(self, steps: int | None = None, seconds: float | None = None, width: int = 1) -> QueryMeta:
        began, done = time.monotonic(), 0
        while (steps is None or done < steps) and (seconds is None or time.monotonic() - began < seconds):
            tree = self.choose()
            if tree is None:
                break
            tree.step(width)
            done += 1
        return max((t.best() for t in self.trees), key=lambda n: n.error).meta


def random_search(tables: list[str], catalog: Catalog, bins: Bins, evaluate: Evaluator, n: int, seed: int) -> list[tuple[QueryMeta, float]]:
    rng = np.random.default_rng(seed)
    metas = [random_query([catalog.aliases[t] for t in tables], catalog, bins, rng) for _ in range(n)]
    return sorted(zip(metas, evaluate(metas), strict=True), key=lambda x: -x[1])


def heuristic_search(tables, catalog, bins, estimate_error: Evaluator, evaluate: Evaluator, n: int, keep: int, seed: int) -> list[tuple[QueryMeta, float]]:
    """Only the candidates with the largest q-errors are evaluated by plan."""
    first = random_search(tables, catalog, bins, estimate_error, n, seed)[:keep]
    metas = [m for m, _ in first]
    return sorted(zip(metas, evaluate(metas), strict=True), key=lambda x: -x[1])


def feedback_search(tables, catalog, bins, evaluate: Evaluator, rounds: int, batch: int, seed: int) -> list[tuple[QueryMeta, float]]:
    rng, priors, out = np.random.default_rng(seed), Priors(bins), []
    for _ in range(rounds):
        metas = [random_query([catalog.aliases[t] for t in tables], catalog, bins, rng, priors) for _ in range(batch)]
        for m, e in zip(metas, evaluate(metas), strict=True):
            priors.feedback(m, e)
            out.append((m, e))
    return sorted(out, key=lambda x: -x[1])


def schedule(costs: dict[str, float], slots: int) -> list[list[str]]:
    """Longest processing time first, each to the least loaded slot."""
    heap = [(0.0, i) for i in range(slots)]
    out: list[list[str]] = [[] for _ in range(slots)]
    for name in sorted(costs, key=lambda k: (-costs[k], k)):
        load, i = heapq.heappop(heap)
        out[i].append(name)
        heapq.heappush(heap, (load + costs[name], i))
    return out


def distant_selection(items: list, score: Callable, distance: Callable, limit: int, least: float) -> list:
    """Take the best item, drop those closer than ``least``, repeat."""
    rest, out = sorted(items, key=score, reverse=True), []
    while rest and len(out) < limit:
        out.append(rest.pop(0))
        rest = [x for x in rest if distance(x, out[-1]) >= least]
    return out


def task_decisions(rewards: dict[str, float], finished: list[float], pauses: dict[str, int], most_pauses: int = 3) -> dict[str, str]:
    """run, pause or stop per task: those at or above the median of finished rewards run."""
    middle = float(np.median(finished)) if finished else 0.0
    return {t: "run" if r >= middle else "stop" if pauses.get(t, 0) >= most_pauses else "pause" for t, r in rewards.items()}


def template_weights(worst: dict[str, float], improvement: dict[str, float]) -> dict[str, float]:
    """0.75 of the normalised largest error less one, 0.25 of the normalised recent improvement."""
    a, b = sum(max(0.0, v - 1) for v in worst.values()) or 1.0, sum(improvement.values()) or 1.0
    return {k: 0.75 * max(0.0, worst[k] - 1) / a + 0.25 * improvement.get(k, 0.0) / b for k in worst}


def gaussian_process(x: np.ndarray, y: np.ndarray, at: np.ndarray, length: float = 0.3, noise: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of a squared-exponential process."""
    k = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) / (2 * length**2))
    scale = y.std() or 1.0
    z = (y - y.mean()) / scale
    inv = np.linalg.inv(k(x, x) + noise * np.eye(len(x)))
    cross = k(at, x)
    var = np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", cross, inv, cross))
    return y.mean() + scale * cross @ inv @ z, scale * np.sqrt(var)


def bayesian_search(dims: int, evaluate: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator, *, initial: int = 50, rounds: int = 5, batch: int = 5) -> tuple[np.ndarray, float]:
    """Maximise over the unit cube: random points, then batches by expected improvement."""
    x = rng.random((initial, dims))
    y = np.asarray(evaluate(x), dtype=float)
    for _ in range(rounds):
        at = rng.random((512, dims))
        mean, dev = gaussian_process(x, y, at)
        u = (mean - y.max()) / dev
        gain = dev * (u * 0.5 * (1 + np.vectorize(math.erf)(u / math.sqrt(2))) + np.exp(-u * u / 2) / math.sqrt(2 * math.pi))
        pick = at[np.argsort(-gain)[:batch]]
        x, y = np.vstack([x, pick]), np.concatenate([y, evaluate(pick)])
    return x[y.argmax()], float(y.max())


def expected_p_error(sample: Callable[[np.random.Generator], dict], evaluate: Callable[[dict], float], n: int, rng: np.random.Generator) -> tuple[float, float]:
    """Mean and deviation of the p-error over sampled cardinalities."""
    v = np.array([evaluate(sample(rng)) for _ in range(n)])
    return float(v.mean()), float(v.std())
