"""Cubes of query templates: exact counts of a template's queries, of regions of cells, and of all sub-joins.

A template's tables are joined once and counted by the bins of its filtered columns. Unlike ``cube.cube``, rows whose
binned value is null stay, in cells with a null bin: they count where a query leaves the column free and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import ceil, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planscope.catalog import Catalog
from planscope.functions.estimators import Estimator
from planscope.functions.metrics import q_error
from planscope.meta import QueryMeta, RangeFilter
from planscope.operators import cube as cb
from planscope.operators.relation import JoinTree, Tables, as_integer, count_batch, relation

Bins = dict[tuple[str, str], list[int]]  # (alias, column) -> boundaries


def _label(alias: str, column: str) -> str:
    return f"{alias}_{column}"


def join_cells(names: Iterable[str], catalog: Catalog, tables: Tables, bins: Bins) -> DataFrame:
    """``bin_<alias>_<column>`` per binned column and ``cnt``, over the join of the tables.

    Every side whose keys repeat is counted by its key and bins before it meets the next table, so siblings are never
    multiplied out; joins with a cycle are built first."""
    names = tuple(names)
    aliases = {catalog.aliases[t] for t in names}
    bins = {k: b for k, b in bins.items() if k[0] in aliases}
    index = lambda k: cb.bin_index(as_integer(F.col(_label(*k))), bins[k])
    kept = lambda k: F.when(F.col(_label(*k)).isNotNull(), index(k)).alias(f"bin_{_label(*k)}")
    tree = JoinTree.of(names, catalog)
    if tree is None:
        rows = relation(QueryMeta(names), catalog, tables)
        return rows.groupBy(*[kept(k) for k in bins]).agg(F.count("*").alias("cnt"))

    def counted(table: str, parent: str | None) -> DataFrame:
        a = catalog.aliases[table]
        own = {key for n, (mine, _) in tree.edges[table].items() for key in mine}
        rows = tables(table)
        rows = rows.select(*[F.col(c).alias(_label(a, c)) for c in own | {k[1] for k in bins if k[0] == a}])
        rows = rows.select(*[_label(a, c) for c in sorted(own)], *[kept(k) for k in bins if k[0] == a], F.lit(1).cast("long").alias(f"n_{a}"))
        ways = F.col(f"n_{a}")
        for child, (mine, theirs) in tree.edges[table].items():
            if child != parent:
                b = catalog.aliases[child]
                on = [F.col(_label(a, m)) == F.col(_label(b, t)) for m, t in zip(mine, theirs, strict=True)]
                rows, ways = rows.join(counted(child, table), reduce(lambda x, y: x & y, on)), ways * F.col(f"n_{b}")
        held = [c for c in rows.columns if c.startswith("bin_")]
        if parent is None:
            return rows.groupBy(*held).agg(F.coalesce(F.sum(ways), F.lit(0)).alias("cnt"))
        keys = [_label(a, k) for k in tree.edges[table][parent][0]]
        if tree.is_unique(table, tree.edges[table][parent][0]):
            return rows.select(*keys, *held, ways.alias(f"n_{a}"))
        return rows.groupBy(*keys, *held).agg(F.sum(ways).alias(f"n_{a}"))

    return counted(min(tree.edges, key=tree.repeated_keys), None)


@dataclass
class TemplateCube:
    """The cells of one table set and the boundaries of its binned columns."""

    tables: tuple[str, ...]
    bins: Bins
    cells: DataFrame

    @classmethod
    def build(cls, names: Iterable[str], catalog: Catalog, tables: Tables, bins: Bins) -> TemplateCube:
        names = tuple(sorted(names))
        inside = {catalog.aliases[t] for t in names}
        return cls(names, {k: b for k, b in bins.items() if k[0] in inside}, join_cells(names, catalog, tables, bins))

    @property
    def columns(self) -> list[str]:
        return [_label(*k) for k in self.bins]

    def region_of(self, meta: QueryMeta) -> dict[str, tuple[int, int]] | None:
        """Bin numbers (inclusive) of a query's filters by column; None if a bound is no bin edge or a column isn't
        binned. An open side reaches beyond the outermost boundary."""
        if meta.tables != self.tables:
            return None
        out: dict[str, tuple[int, int]] = {}
        for f in meta.filters:
            edges = self.bins.get((f.alias, f.column))
            if edges is None or (f.lower is not None and f.lower - 1 not in edges) or (f.upper is not None and f.upper not in edges):
                return None
            low = 0 if f.lower is None else edges.index(f.lower - 1) + 1
            high = len(edges) if f.upper is None else edges.index(f.upper)
            before = out.get(_label(f.alias, f.column), (0, len(edges)))
            out[_label(f.alias, f.column)] = (max(low, before[0]), min(high, before[1]))
        return out

    def ranges(self, metas: dict[str, QueryMeta]) -> DataFrame:
        """The range table of ``cube.slice_batch`` for queries whose bounds are bin edges (an error for others)."""
        rows = []
        for name, m in metas.items():
            region = self.region_of(m)
            if region is None:
                raise ValueError(f"{name}: bounds must be bin edges of the cube")
            rows.append((name, *[x for c in self.columns for x in region.get(c, (None, None))]))
        return self.cells.sparkSession.createDataFrame(rows, "query_id string" + "".join(f", lo_{c} int, hi_{c} int" for c in self.columns))

    def counts(self, metas: dict[str, QueryMeta]) -> DataFrame:
        """(query_id, cardinality) from the cells."""
        if not self.columns:
            total = self.cells.select(F.col("cnt").alias("cardinality"))
            return reduce(DataFrame.unionByName, [total.select(F.lit(n).alias("query_id"), "cardinality") for n in metas])
        return cb.slice_batch(self.cells, self.ranges(metas), self.columns)

    def counts_or_direct(self, metas: dict[str, QueryMeta], catalog: Catalog, tables: Tables) -> DataFrame:
        """``counts``; queries whose bounds are no bin edges are counted directly."""
        aligned = {n: m for n, m in metas.items() if self.region_of(m) is not None}
        other = {n: m for n, m in metas.items() if n not in aligned}
        parts = [self.counts(aligned)] * bool(aligned) + [count_batch(other, catalog, tables)] * bool(other)
        return reduce(DataFrame.unionByName, parts)

    def region_meta(self, region: dict[str, tuple[int, int]]) -> QueryMeta:
        """The query of a region: value ranges from bin numbers."""
        filters = []
        for (alias, column), edges in self.bins.items():
            if (r := region.get(_label(alias, column))) is not None:
                filters.append(RangeFilter(alias, column, edges[r[0] - 1] + 1 if r[0] > 0 else None, edges[r[1]] if r[1] < len(edges) else None))
        return QueryMeta(self.tables, tuple(filters))

    def cell_metas(self, flat: Iterable[int]) -> dict[str, QueryMeta]:
        """The queries of single cells, by row-major number over the inner bins (numbered from 0), keyed by the number."""
        out = {}
        for number in flat:
            rest, region = number, {}
            for (alias, column), edges in reversed(self.bins.items()):
                rest, k = divmod(rest, len(edges) - 1)
                region[_label(alias, column)] = (k + 1, k + 1)
            if rest:
                raise ValueError(f"no cell {number}")
            out[str(number)] = self.region_meta(region)
        return out

    def region_labels(self, regions: DataFrame) -> DataFrame:
        """Regions (query_id, lo_<c>, hi_<c>) with the value ranges lower_<c>, upper_<c> and the exact cardinality."""
        out = regions.join(cb.slice_batch(self.cells, regions, self.columns), "query_id")
        for key, edges in self.bins.items():
            c = _label(*key)
            at = lambda i, e=edges: F.get(F.array(*[F.lit(x).cast("long") for x in e]), i)
            out = out.withColumns({f"lower_{c}": at(F.col(f"lo_{c}") - 1) + 1, f"upper_{c}": at(F.col(f"hi_{c}"))})
        return out.select("query_id", *[f"{p}_{c}" for c in self.columns for p in ("lower", "upper")], "cardinality")

    def evaluated(self, metas: dict[str, QueryMeta], estimator: Estimator) -> DataFrame:
        """(query_id, cardinality, estimate, q_error) of an estimator on regions, with 1 added to both sides."""
        guesses = list(zip(metas, estimator.estimate(list(metas.values())), strict=True))
        known = self.cells.sparkSession.createDataFrame(guesses, "query_id string, estimate double")
        return self.counts(metas).join(known, "query_id").withColumn("q_error", q_error(F.col("cardinality"), F.col("estimate"), 1))


def sub_join_cubes(names: Iterable[str], catalog: Catalog, tables: Tables, bins: Bins) -> dict[tuple[str, ...], TemplateCube]:
    """A cube for each connected part of a table set, single tables included, by aliases."""
    return {key: TemplateCube.build([catalog.tables_by_alias[a] for a in key], catalog, tables, bins) for key in catalog.sub_joins(names, 1)}


def plan_cards(cubes: dict[tuple[str, ...], TemplateCube], metas: dict[str, QueryMeta], catalog: Catalog) -> DataFrame:
    """(query_id, aliases, cardinality) of all parts of all queries: what a planner needs, from the cubes alone."""
    parts = []
    for key, c in cubes.items():
        own = {n: m.restricted(key, catalog) for n, m in metas.items()}
        parts.append(c.counts(own).select("query_id", F.array(*[F.lit(a) for a in key]).alias("aliases"), "cardinality"))
    return reduce(DataFrame.unionByName, parts)


def table_cube(table: str, catalog: Catalog, tables: Tables, n: int, budget: int, columns: list[str] | None = None) -> TemplateCube:
    """The cube of one table over its ``n`` best-ranked columns, each with the n-th root of the cell budget as its bins."""
    alias, rows = catalog.aliases[table], tables(table)
    ranked = cb.rank_columns(cb.column_features(rows, columns or list(catalog.predicate_columns[table]), 0))
    best = [r.column for r in ranked.orderBy("score", "column").limit(n).collect()]
    share = root_budget(budget, len(best))
    return TemplateCube.build([table], catalog, tables, {(alias, c): cb.collect_bins(cb.bin_boundaries(rows, c, share)) for c in best})


def root_budget(budget: int, n: int) -> int:
    """The least share per column whose n-th power reaches the budget."""
    share = max(1, ceil(budget ** (1 / max(n, 1))))
    return share - 1 if share > 1 and (share - 1) ** n >= budget else share


def affordable_sets(sizes: dict[str, int], fixed: Iterable[str], budget: int) -> list[tuple[str, ...]]:
    """All sets of further columns whose cube, with the fixed ones, has at most ``budget`` cells; small sets first."""
    base, extra = prod(sizes[c] for c in fixed), sorted(set(sizes) - set(fixed))
    every = (s for n in range(len(extra) + 1) for s in combinations(extra, n))
    return [s for s in every if base * prod(sizes[c] for c in s) <= budget]


def nontrivial_cells(cells: DataFrame, columns: list[str], least: float = 1e-3) -> DataFrame:
    """Cells whose count is more than ``least`` times what independent columns would give, with that ratio."""
    known = cells.where(reduce(lambda a, b: a & b, [F.col(f"bin_{c}").isNotNull() for c in columns]))
    return cb.independence(known, columns).where(F.col("under_ratio") > least)


def random_cells(cells: DataFrame, columns: list[str], k: int, seed: int, least: float = 1e-3) -> DataFrame:
    """k of the non-trivial cells without replacement; the seed decides, not the order of rows."""
    draw = F.xxhash64(F.lit(seed), *[F.col(f"bin_{c}") for c in columns])
    return nontrivial_cells(cells, columns, least).orderBy(draw, *[f"bin_{c}" for c in columns]).limit(k)


def random_regions(cube: TemplateCube, k: int, seed: int) -> DataFrame:
    """k regions with bounds drawn per column (query_id, lo_<c>, hi_<c>)."""
    def drawn(c: str, size: int, which: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.lit(which), F.col("id")), F.lit(size)) + 1).cast("int")

    out = [F.col("id").cast("string").alias("query_id")]
    for key, edges in cube.bins.items():
        c, size = _label(*key), len(edges) - 1
        a, b = drawn(c, size, 0), drawn(c, size, 1)
        out += [F.least(a, b).alias(f"lo_{c}"), F.greatest(a, b).alias(f"hi_{c}")]
    return cube.cells.sparkSession.range(k).select(*out)


def regions_near(cube: TemplateCube, target: float, k: int, candidates: int, seed: int, relative: bool = False) -> DataFrame:
    """The k of ``candidates`` random regions whose exact count is nearest to a target on a logarithmic scale;
    ``relative``: the target is a share of all rows of the cube."""
    labels = cube.region_labels(random_regions(cube, candidates, seed))
    if relative:
        labels = labels.join(F.broadcast(cube.cells.agg((F.sum("cnt") * target).alias("__goal")))).withColumn("__goal", F.col("__goal").cast("double"))
    else:
        labels = labels.withColumn("__goal", F.lit(float(target)))
    gap = F.abs(F.log((F.col("cardinality") + 1) / (F.col("__goal") + 1)))
    return labels.orderBy(gap, "query_id").limit(k).drop("__goal")
