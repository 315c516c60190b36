"""Schema knowledge: tables, aliases, keys, column equivalence classes and connected table sets.

Pure Python: catalogs are small. Table sets are enumerated over the graph in which two tables are adjacent when a
column of each lies in the same equivalence class, so sibling foreign keys join directly.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class Catalog:
    aliases: dict[str, str]  # table -> alias
    primary_keys: dict[str, str]
    foreign_keys: tuple[ForeignKey, ...]
    predicate_columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    column_types: dict[str, dict[str, str]] = field(default_factory=dict)

    def __hash__(self):
        return id(self)

    @cached_property
    def tables_by_alias(self) -> dict[str, str]:
        out = {a: t for t, a in self.aliases.items()}
        if len(out) != len(self.aliases):
            raise ValueError("aliases must be unique")
        return out

    @cached_property
    def classes(self) -> tuple[frozenset[tuple[str, str]], ...]:
        """Equivalence classes of (table, column) under the foreign keys."""
        parent: dict[tuple[str, str], tuple[str, str]] = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for fk in self.foreign_keys:
            a, b = root((fk.table, fk.column)), root((fk.ref_table, fk.ref_column))
            if a != b:
                parent[max(a, b)] = min(a, b)
        groups: dict[tuple[str, str], set] = {}
        for x in parent:
            groups.setdefault(root(x), set()).add(x)
        return tuple(frozenset(g) for _, g in sorted(groups.items()))

    def join_pairs(self, left: Iterable[str], right: str) -> list[tuple[str, str, str, str]]:
        """(left table, column, right table, column): one pair for each class that both sides have a column in."""
        left = sorted(left)
        out = []
        for group in self.classes:
            mine = sorted(x for x in group if x[0] in left)
            theirs = sorted(x for x in group if x[0] == right)
            if mine and theirs:
                out.append((*mine[0], *theirs[0]))
        return out

    def join_columns(self, tables: Iterable[str]) -> dict[str, list[str]]:
        """Key columns of each table: its primary key and the columns in any class."""
        out = {}
        for t in tables:
            cols = {c for g in self.classes for u, c in g if u == t} | ({self.primary_keys[t]} if t in self.primary_keys else set())
            out[t] = sorted(cols)
        return out

    def adjacent(self, a: str, b: str) -> bool:
        return bool(self.join_pairs([a], b))

    def neighbours(self, tables: Iterable[str]) -> list[str]:
        """Tables outside the set that join with it."""
        tables = set(tables)
        return sorted(t for t in self.aliases if t not in tables and self.join_pairs(tables, t))

    def connected(self, tables: Iterable[str]) -> bool:
        tables = set(tables)
        if not tables:
            return False
        seen, todo = set(), [min(tables)]
        while todo:
            t = todo.pop()
            seen.add(t)
            todo += [u for u in tables - seen if self.adjacent(t, u)]
        return seen == tables

    def sub_joins(self, tables: Iterable[str], least: int = 2) -> list[tuple[str, ...]]:
        """Connected subsets with at least ``least`` tables, as sorted tuples of aliases, smaller ones first."""
        tables = sorted(tables)
        out = []
        for n in range(least, len(tables) + 1):
            out += [tuple(sorted(self.aliases[t] for t in s)) for s in combinations(tables, n) if self.connected(s)]
        return sorted(out, key=lambda s: (len(s), s))

    def join_order(self, tables: Iterable[str]) -> list[str]:
        """Greedy connected order: start with the first table, then always the first that joins; error if none does."""
        rest = list(tables)
        order = [rest.pop(0)] if rest else []
        while rest:
            step = next((t for t in rest if self.join_pairs(order, t)), None)
            if step is None:
                raise ValueError(f"{rest} don't join with {order}")
            rest.remove(step)
            order.append(step)
        return order

    def restricted(self, tables: Iterable[str]) -> Catalog:
        """The catalog of some tables: other tables and keys that touch them go."""
        keep = set(tables)
        return Catalog(
            {t: a for t, a in self.aliases.items() if t in keep}, {t: c for t, c in self.primary_keys.items() if t in keep},
            tuple(f for f in self.foreign_keys if f.table in keep and f.ref_table in keep),
            {t: c for t, c in self.predicate_columns.items() if t in keep}, {t: c for t, c in self.column_types.items() if t in keep},
        )

    def valid_columns(self, table: str, null_rates: dict[str, float], limit: float = 0.3) -> list[str]:
        """Predicate columns: the declared ones, else numeric columns that are no keys and are not too often null."""
        if table in self.predicate_columns:
            return list(self.predicate_columns[table])
        keys = set(self.join_columns([table])[table])
        return [c for c, t in self.column_types.get(table, {}).items() if c not in keys and not _is_text(t) and null_rates.get(c, 0.0) < limit]

    def split_column(self, name: str) -> tuple[str, str]:
        """``alias_column`` at the longest alias that is a prefix."""
        best = max((a for a in self.tables_by_alias if name.startswith(a + "_")), key=len, default=None)
        if best is None:
            raise ValueError(f"no alias starts {name!r}")
        return best, name[len(best) + 1 :]


def _is_text(kind: str) -> bool:
    return "char" in kind or kind in ("string", "text")


def load_catalog(path: str, aliases: dict[str, str] | None = None) -> Catalog:
    """A catalog from a header file (JSON): all_columns, primary_keys, column_types, foreign_keys, table_spec, column_spec."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    tables = data.get("table_spec") or list(data["all_columns"])
    keys = tuple(ForeignKey(t, *fk) for t, fks in data.get("foreign_keys", {}).items() for fk in fks)
    whole = Catalog(
        aliases or {t: t for t in data["all_columns"]}, data.get("primary_keys", {}), keys,
        {t: tuple(c) for t, c in data.get("column_spec", {}).items()}, {t: dict(c) for t, c in data.get("column_types", {}).items()},
    )
    return whole.restricted(tables)


#: The workload over the driver's tables.
SHOP = Catalog(
    {"customer": "c", "orders": "o", "events": "e", "lineitem": "l", "part": "p", "supplier": "s", "nation": "n", "region": "r"},
    {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id"},
    (
        ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("events", "user_id", "customer", "c_custkey"),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"), ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    ),
    {"customer": ("c_acctbal",), "orders": ("o_totalprice",), "events": ("value",), "lineitem": ("l_quantity", "l_extendedprice"), "part": ("p_size", "p_retailprice"), "supplier": ("s_acctbal",)},
)
