"""Queries as DataFrames: filters, joins along inferred keys, counts of many queries in few jobs, stored joins."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planscope.catalog import Catalog
from planscope.meta import QueryMeta, RangeFilter

Tables = Callable[[str], DataFrame]


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def as_integer(c: Column) -> Column:
    """The integer value of a predicate column: cut toward zero, the same for bins, cubes and predicates."""
    return c.cast("long")


def prefixed(df: DataFrame, alias: str) -> DataFrame:
    """Columns renamed ``alias_column`` (self-describing in joins)."""
    return df.withColumnsRenamed({c: f"{alias}_{c}" for c in df.columns})


def condition(f: RangeFilter, column: Column | None = None) -> Column:
    """A range as a Column: inclusive bounds of the integer value, NULL never passes, NaN is above all bounds.

    The bounds are written for the bare column, so that they reach the scan: cut toward zero, a value is at least
    ``n`` if it exceeds ``n - 1`` (n up to 0) or reaches ``n`` (n above 0), and likewise from above."""
    c = F.col(f"{f.alias}_{f.column}") if column is None else column
    out = c.isNotNull()
    if f.lower is not None:
        out &= (c > f.lower - 1) if f.lower <= 0 else (c >= f.lower)
    if f.upper is not None:
        out &= (c < f.upper + 1) if f.upper >= 0 else (c <= f.upper)
    return out


def apply_filters(df: DataFrame, filters: Iterable[RangeFilter]) -> DataFrame:
    conds = [condition(f) for f in filters]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def relation(meta: QueryMeta, catalog: Catalog, tables: Tables, columns: Iterable[str] | None = None, order: list[str] | None = None, hints: dict[str, str] | None = None) -> DataFrame:
    """The joined and filtered relation of a query, columns named ``alias_column``.

    Joins follow ``order`` (default: a connected order; Catalyst may still reorder); keys are inferred from the catalog's
    equivalence classes, so NULL keys never match. ``hints`` names a join strategy per alias.
    """
    out, done = None, []
    for t in order or catalog.join_order(meta.tables):
        a = catalog.aliases[t]
        part = apply_filters(prefixed(tables(t), a), [f for f in meta.filters if f.alias == a])
        if hints and a in hints:
            part = part.hint(hints[a])
        if out is None:
            out = part
        else:
            pairs = catalog.join_pairs(done, t)
            if not pairs:
                raise ValueError(f"{t} doesn't join with {done}")
            on = [out[f"{catalog.aliases[lt]}_{lc}"] == part[f"{a}_{rc}"] for lt, lc, _, rc in pairs]
            out = out.join(part, reduce(lambda x, y: x & y, on), "inner")
        done.append(t)
    return out.select(*columns) if columns is not None else out


def count_query(meta: QueryMeta, catalog: Catalog, tables: Tables) -> DataFrame:
    """One row with the cardinality of a query."""
    return count_batch({"": meta}, catalog, tables).select("cardinality")


def hull(metas: Iterable[QueryMeta]) -> tuple[RangeFilter, ...]:
    """The tightest ranges that hold in every query: columns that all of them filter, with the widest bounds."""
    per_query = []
    for m in metas:
        own: dict[tuple[str, str], tuple[list, list]] = {}
        for f in m.filters:
            lows, highs = own.setdefault((f.alias, f.column), ([], []))
            lows += [f.lower] if f.lower is not None else []
            highs += [f.upper] if f.upper is not None else []
        per_query.append({k: (max(lo, default=None), min(hi, default=None)) for k, (lo, hi) in own.items()})
    shared = set.intersection(*[set(q) for q in per_query]) if per_query else set()
    widest = lambda bounds, pick: None if None in bounds else pick(bounds)
    return tuple(RangeFilter(*k, widest([q[k][0] for q in per_query], min), widest([q[k][1] for q in per_query], max)) for k in sorted(shared))


def _all_of(filters: Iterable[RangeFilter]) -> Column:
    return reduce(lambda a, b: a & b, [condition(f) for f in filters], F.lit(True))


@dataclass
class JoinTree:
    """The joins of a table set as a tree; an edge holds the key columns of either side. ``None`` from ``of``: the joins
    form a cycle, as a table meets several others through different keys."""

    edges: dict[str, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]]  # table -> neighbour -> (own keys, its keys)
    unique: dict[str, str]

    @classmethod
    def of(cls, names: Iterable[str], catalog: Catalog) -> JoinTree | None:
        order = catalog.join_order(names)
        edges: dict[str, dict] = {t: {} for t in order}
        for i, t in enumerate(order[1:], 1):
            pairs = catalog.join_pairs(order[:i], t)
            if len({p[0] for p in pairs}) > 1:
                return None
            other, theirs, mine = pairs[0][0], tuple(p[1] for p in pairs), tuple(p[3] for p in pairs)
            edges[t][other], edges[other][t] = (mine, theirs), (theirs, mine)
        return cls(edges, {t: c for t, c in catalog.primary_keys.items() if t in edges})

    def is_unique(self, table: str, keys: tuple[str, ...]) -> bool:
        return self.unique.get(table) in keys

    def below(self, table: str, parent: str | None) -> list[str]:
        return [table] + [x for n in self.edges[table] if n != parent for x in self.below(n, table)]

    def repeated_keys(self, table: str, parent: str | None = None) -> int:
        """How many sides below a root must be grouped, as their keys repeat."""
        return sum(not self.is_unique(n, keys) for n, (_, keys) in self.edges[table].items() if n != parent) + sum(
            self.repeated_keys(n, table) for n in self.edges[table] if n != parent
        )


def _weights(tree: JoinTree, table: str, parent: str | None, metas: list[QueryMeta], catalog: Catalog, tables: Tables, bounds: tuple[RangeFilter, ...]) -> tuple[DataFrame, list[str]]:
    """The rows of ``table`` with, per query, the number of joined rows that the tables below add to each; grouped by the
    keys toward ``parent`` unless they are unique. Queries that agree on all tables below share a column."""
    a = catalog.aliases[table]
    df = apply_filters(prefixed(tables(table), a), [f for f in bounds if f.alias == a])
    factors: list[list[Column]] = [[] for _ in metas]
    for child, (mine, theirs) in tree.edges[table].items():
        if child == parent:
            continue
        part, names = _weights(tree, child, table, metas, catalog, tables, bounds)
        b = catalog.aliases[child]
        df = df.join(part, reduce(lambda x, y: x & y, [F.col(f"{a}_{m}") == F.col(f"{b}_{t}") for m, t in zip(mine, theirs, strict=True)]))
        for own, n in zip(factors, names, strict=True):
            own.append(F.col(n))
    inside = {catalog.aliases[t] for t in tree.below(table, parent)}
    columns: dict[tuple, tuple[str, Column]] = {}
    names = []
    for m, own in zip(metas, factors, strict=True):
        key = tuple(f for f in m.filters if f.alias in inside)
        if key not in columns:
            local = [f for f in m.filters if f.alias == a]
            ways = reduce(lambda x, y: x * y, own, F.lit(1).cast("long"))
            columns[key] = (f"__{a}_w{len(columns)}", F.when(_all_of(local), ways).otherwise(0) if local else ways)
        names.append(columns[key][0])
    if parent is None:
        return df.agg(*[F.coalesce(F.sum(w), F.lit(0)).cast("long").alias(n) for n, w in columns.values()]), names
    keys = tree.edges[table][parent][0]
    to_parent = [f"{a}_{k}" for k in keys]
    if tree.is_unique(table, keys):
        return df.select(*to_parent, *[w.alias(n) for n, w in columns.values()]), names
    return df.groupBy(*to_parent).agg(*[F.sum(w).alias(n) for n, w in columns.values()]), names


def count_batch(metas: dict[str, QueryMeta], catalog: Catalog, tables: Tables) -> DataFrame:
    """(query_id, cardinality) of many queries. Queries over the same tables share one pass over the rows that their
    common bounds (``hull``) leave, with a conditional count for each query.

    Where the joins form a tree, no join of rows with rows that repeat a key is ever built: each side is first counted by
    its key (partial counts before the shuffle, so a hot key is one row) and the counts are multiplied. The root is a
    table that leaves the fewest sides to group. Joins with a cycle are built and counted."""
    groups: OrderedDict[tuple[str, ...], dict[str, QueryMeta]] = OrderedDict()
    for name, m in metas.items():
        groups.setdefault(m.tables, {})[name] = m
    parts = []
    for names, own in groups.items():
        queries, bounds = list(own.values()), hull(own.values())
        tree = JoinTree.of(names, catalog)
        if tree is not None:
            root = min(tree.edges, key=tree.repeated_keys)
            row, columns = _weights(tree, root, None, queries, catalog, tables, bounds)
        else:
            columns = [f"q{i}" for i in range(len(own))]
            wide = relation(QueryMeta(names, bounds), catalog, tables)
            row = wide.agg(*[F.count_if(_all_of(m.filters)).alias(c) for c, m in zip(columns, queries, strict=True)])
        stacked = ", ".join(f"'{n}', {c}" for n, c in zip(own, columns, strict=True))
        parts.append(row.selectExpr(f"stack({len(own)}, {stacked}) AS (query_id, cardinality)"))
    return reduce(DataFrame.unionByName, parts)


def counts_with_timeout(spark: SparkSession, jobs: dict[str, DataFrame], seconds: float, workers: int = 8) -> dict[str, int | None]:
    """Counts of many relations from a thread pool; a job that takes too long is cancelled and gives None."""

    def run(item):
        name, df = item
        spark.sparkContext.setJobGroup(f"count-{name}", name, interruptOnCancel=True)
        return df.count()

    out: dict[str, int | None] = {}
    with ThreadPoolExecutor(workers) as pool:
        futures = {n: pool.submit(run, (n, df)) for n, df in jobs.items()}
        for n, f in futures.items():
            try:
                out[n] = f.result(timeout=seconds)
            except FutureTimeout:
                spark.sparkContext.cancelJobGroup(f"count-{n}")
                out[n] = None
            except Exception:  # a cancelled or failed query has no count
                out[n] = None
    return out


def null_rates(df: DataFrame) -> DataFrame:
    """(column, null_rate) of all columns in one pass; 0 for an empty table."""
    row = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in df.columns])
    rate = lambda c: f"coalesce(1 - try_divide(cast(`{c}` as double), __n), 0.0D)"
    return row.selectExpr(f"stack({len(df.columns)}, " + ", ".join(f"'{c}', {rate(c)}" for c in df.columns) + ") AS (column, null_rate)")


def min_max(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, lo, hi) of integer values in one pass."""
    columns = list(columns)
    row = df.agg(*[f(as_integer(F.col(c))).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return row.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', lo_{c}, hi_{c}" for c in columns) + ") AS (column, lo, hi)")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt) of non-null integer values."""
    return df.where(F.col(column).isNotNull()).groupBy(as_integer(F.col(column)).alias("value")).agg(F.count("*").alias("cnt"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]


def clip_columns(df: DataFrame, catalog: Catalog, table: str) -> DataFrame:
    """Without the primary key and text columns."""
    return df.select(*[c for c in numeric_columns(df) if c != catalog.primary_keys.get(table)])


@dataclass
class ViewRegistry:
    """Stored joins: metas to Parquet folders under ``root``, found by canonical equality, dropped oldest first."""

    root: str
    catalog: Catalog
    limit: int = 64
    paths: OrderedDict = field(default_factory=OrderedDict)

    def store(self, meta: QueryMeta, df: DataFrame) -> str:
        path = f"{self.root}/{meta.name(self.catalog)}"
        df.write.mode("overwrite").parquet(path)
        self.paths[meta] = path
        while len(self.paths) > self.limit:
            self.paths.popitem(last=False)
        return path

    def load(self, spark: SparkSession, meta: QueryMeta) -> DataFrame | None:
        return spark.read.parquet(self.paths[meta]) if meta in self.paths else None

    def by_name(self, spark: SparkSession, name: str) -> DataFrame | None:
        return next((self.load(spark, m) for m in self.paths if m.name(self.catalog) == name), None)

    def fetch(self, spark: SparkSession, meta: QueryMeta, tables: Tables) -> DataFrame:
        """The stored relation, else the computed one, stored on the way."""
        if (df := self.load(spark, meta)) is None:
            self.store(meta, relation(meta, self.catalog, tables))
            df = self.load(spark, meta)
        return df

    def clear(self) -> None:
        self.paths.clear()


def grow_bounds(meta: QueryMeta, steps: list[dict[tuple[str, str], tuple[int, int]]], row_limit: int, catalog: Catalog, tables: Tables) -> tuple[QueryMeta, int]:
    """The widest of ever wider bounds whose join stays within ``row_limit`` rows (the first step always counts as
    allowed), with its number. All steps are counted in one batch; nothing is materialised for it."""
    metas = {str(i): meta.template().filled(s) for i, s in enumerate(steps)}
    counts = {r.query_id: r.cardinality for r in count_batch(metas, catalog, tables).collect()}
    best = 0
    for i in range(len(steps)):
        if counts[str(i)] > row_limit and i:
            break
        best = i
    return metas[str(best)], best


def growth_ladder(low: int, high: int, lower: int, upper: int, ratio: float = 1 / 16, rate: float = 2.0) -> list[tuple[int, int]]:
    """Ranges that grow from a share of (lower, upper) to all of (low, high) by ``rate`` per step."""
    out, middle = [], (lower + upper) / 2
    while True:
        half = (high - low) * min(ratio, 1.0) / 2
        out.append((max(low, int(middle - half)), min(high, int(middle + half))) if ratio < 1 else (low, high))
        if ratio >= 1:
            return out
        ratio *= rate
