"""The logical form of a query: a set of tables and inclusive ranges on columns, with SQL text in and out.

A ``QueryMeta`` is immutable and canonical (tables and filters sorted, repeats gone), so equal queries are equal
values. ``None`` is an open bound, ``PLACEHOLDER`` marks a template's bounds. Values are integers: a real-valued
column counts as its value cut toward zero.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

from planscope.catalog import Catalog

PLACEHOLDER = "placeholder"
Bound = int | None | str


@dataclass(frozen=True, order=True)
class RangeFilter:
    alias: str
    column: str
    lower: Bound = None
    upper: Bound = None

    def key(self):
        return (self.alias, self.column, str(self.lower), str(self.upper))

    def text(self) -> str:
        low = "" if self.lower is None else f"{self.lower}<="
        high = "" if self.upper is None else f"<={self.upper}"
        return f"{low}{self.alias}.{self.column}{high}"


def _number(x) -> Bound:
    return x if x is None or x == PLACEHOLDER else int(x)


@dataclass(frozen=True)
class QueryMeta:
    tables: tuple[str, ...]
    filters: tuple[RangeFilter, ...] = ()

    def __post_init__(self):
        fixed = {RangeFilter(f.alias, f.column, _number(f.lower), _number(f.upper)) for f in self.filters}
        object.__setattr__(self, "tables", tuple(sorted(set(self.tables))))
        object.__setattr__(self, "filters", tuple(sorted(fixed, key=RangeFilter.key)))

    # editing gives new values
    def with_tables(self, *tables: str) -> QueryMeta:
        return QueryMeta((*self.tables, *tables), self.filters)

    def with_filters(self, *filters: RangeFilter) -> QueryMeta:
        return QueryMeta(self.tables, (*self.filters, *filters))

    def union(self, other: QueryMeta) -> QueryMeta:
        return QueryMeta(self.tables + other.tables, self.filters + other.filters)

    def intersection(self, other: QueryMeta) -> QueryMeta:
        return QueryMeta(tuple(set(self.tables) & set(other.tables)), tuple(set(self.filters) & set(other.filters)))

    def contains(self, other: QueryMeta) -> bool:
        return set(other.tables) <= set(self.tables) and set(other.filters) <= set(self.filters)

    def restricted(self, aliases: Iterable[str], catalog: Catalog) -> QueryMeta:
        """The part of the query on some aliases."""
        keep = set(aliases)
        return QueryMeta(tuple(t for t in self.tables if catalog.aliases[t] in keep), tuple(f for f in self.filters if f.alias in keep))

    def per_table(self, catalog: Catalog) -> dict[str, QueryMeta]:
        return {catalog.aliases[t]: self.restricted([catalog.aliases[t]], catalog) for t in self.tables}

    def alias_key(self, catalog: Catalog) -> tuple[str, ...]:
        return tuple(sorted(catalog.aliases[t] for t in self.tables))

    def template(self) -> QueryMeta:
        return QueryMeta(self.tables, tuple(RangeFilter(f.alias, f.column, PLACEHOLDER, PLACEHOLDER) for f in self.filters))

    def filled(self, values: dict[tuple[str, str], tuple[Bound, Bound]]) -> QueryMeta:
        """A template with its placeholders replaced; a placeholder without a value is an error."""
        out = []
        for f in self.filters:
            if PLACEHOLDER in (f.lower, f.upper):
                out.append(RangeFilter(f.alias, f.column, *values[f.alias, f.column]))
            else:
                out.append(f)
        return QueryMeta(self.tables, tuple(out))

    def text(self, catalog: Catalog) -> str:
        return f"({','.join(self.alias_key(catalog))})" + "".join("," + f.text() for f in self.filters)

    def name(self, catalog: Catalog) -> str:
        return hashlib.blake2b(self.text(catalog).encode(), digest_size=8).hexdigest()


def join_conditions(meta: QueryMeta, catalog: Catalog) -> list[str]:
    """Equality conditions along a connected order, one for each equivalence class a new table shares with the others."""
    order, out = catalog.join_order(meta.tables), []
    for i, t in enumerate(order[1:], 1):
        for lt, lc, rt, rc in catalog.join_pairs(order[:i], t):
            out.append(f"{catalog.aliases[lt]}.{lc} = {catalog.aliases[rt]}.{rc}")
    return out


def filter_sql(f: RangeFilter, value: str = "{c}") -> str:
    """One range as SQL; ``value`` is how the integer value of a column ``{c}`` is written."""
    c = value.format(c=f"{f.alias}.{f.column}")
    if f.lower is not None and f.lower == f.upper:
        return f"{c} = {f.lower}"
    parts = ([f"{c} >= {f.lower}"] if f.lower is not None else []) + ([f"{c} <= {f.upper}"] if f.upper is not None else [])
    return " AND ".join(parts) or f"{f.alias}.{f.column} IS NOT NULL"


def to_sql(meta: QueryMeta, catalog: Catalog, *, value: str = "{c}", via_keys: bool = False, select: str = "COUNT(*)") -> str:
    """SQL text. ``via_keys`` adds the table of a primary key where several tables meet only through its foreign keys."""
    if via_keys:
        extra = set()
        for group in catalog.classes:
            here = {t for t, _ in group if t in meta.tables}
            owner = {t for t, c in group if catalog.primary_keys.get(t) == c}
            if len(here) > 1 and owner and not owner & here:
                extra |= {min(owner)}
        meta = meta.with_tables(*extra)
    tables = ", ".join(f"{t} AS {catalog.aliases[t]}" for t in catalog.join_order(meta.tables))
    where = join_conditions(meta, catalog) + [filter_sql(f, value) for f in meta.filters]
    return f"SELECT {select} FROM {tables}" + (" WHERE " + " AND ".join(where) if where else "")


_CONDITION = re.compile(r"^([\w.]+)\s*(<=|>=|!=|<>|<|>|=)\s*([\w.+-]+)$")


def parse_sql(sql: str, catalog: Catalog) -> QueryMeta:
    """The meta of ``SELECT ... FROM t [AS] a, ... WHERE`` with AND-ed ranges and joins along the catalog's keys.

    ``>`` and ``<`` become inclusive bounds of integers; several conditions on a column intersect. ``!=``, OR, and
    joins that the catalog doesn't know are errors."""
    text = re.sub(r"\s+", " ", sql.strip().rstrip(";")).replace('"', "")
    m = re.match(r"(?i)^select .*? from (.*?)(?: where (.*))?$", text)
    if not m:
        raise ValueError(f"not a select: {sql!r}")
    named: dict[str, str] = {}
    for part in m[1].split(","):
        words = [w for w in part.split() if w.lower() != "as"]
        if words[0] not in catalog.aliases or len(words) > 2:
            raise ValueError(f"unknown table in {part!r}")
        named[words[-1] if len(words) == 2 else catalog.aliases[words[0]]] = words[0]
    bounds: dict[tuple[str, str], list[Bound]] = {}
    for cond in re.split(r"(?i) and ", m[2]) if m[2] else []:
        cond = cond.strip(" ()")
        if cond.upper() == "TRUE":
            continue
        if nn := re.match(r"(?i)^([\w.]+) is not null$", cond):
            a, c = nn[1].split(".")
            bounds.setdefault((catalog.aliases[named[a]], c), [None, None])
            continue
        p = _CONDITION.match(cond)
        if not p:
            raise ValueError(f"can't read {cond!r}")
        left, op, right = p.groups()
        a, c = left.split(".")
        if re.match(r"^[A-Za-z_]\w*\.\w+$", right):
            b, d = right.split(".")
            known = any({(named[a], c), (named[b], d)} <= g for g in catalog.classes)
            if op != "=" or not known:
                raise ValueError(f"unknown join {cond!r}")
            continue
        if op in ("!=", "<>"):
            raise ValueError(f"{op} has no range: {cond!r}")
        v, own = int(right), bounds.setdefault((catalog.aliases[named[a]], c), [None, None])
        low = v if op in ("=", ">=") else v + 1 if op == ">" else None
        high = v if op in ("=", "<=") else v - 1 if op == "<" else None
        if low is not None:
            own[0] = low if own[0] is None else max(own[0], low)
        if high is not None:
            own[1] = high if own[1] is None else min(own[1], high)
    return QueryMeta(tuple(named.values()), tuple(RangeFilter(a, c, *b) for (a, c), b in bounds.items()))
