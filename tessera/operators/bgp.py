"""Scans of triple patterns, joins, unions and projection.

A source gives Bound tables: over the virtual graph with raw keys, over triples with full terms.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.terms import is_variable, variable_name
from tessera.plans.order import Part, join_order
from tessera.plans.sparql import BGPQuery, TriplePattern, parse
from tessera.sources.relational import ENTITIES, FULL, Bound, Mapping, RelationalGraph, Side, Term

#: Share of a table's rows that an equality with a constant is taken to keep, for the join order.
SELECTIVITY = 0.001
#: Bytes of a row in a file, to turn file sizes into rows; only ratios matter.
ROW_BYTES = 20.0


def size_of(df: DataFrame) -> float:
    """Catalyst's estimate of bytes, from file sizes; no job runs."""
    return float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on the common columns, or the product if there are none."""
    common = [c for c in a.columns if c in b.columns]
    return a.join(b, common, "inner") if common else a.crossJoin(b)


def scan_triples(triples: DataFrame, pattern: TriplePattern) -> Bound:
    """Solutions of a pattern over (s, p, o), a set of triples. A bag: one for each triple that matches.

    Constants are filters on the columns, so Parquet sources prune partitions and row groups by them. A variable that
    comes twice asks for equal terms. A pattern without variables gives one row without columns for a match.
    """
    filters, names = [], {}
    for place, value in zip("spo", pattern.terms):
        if not is_variable(value):
            filters.append(F.col(place) == F.lit(value))
        elif (name := variable_name(value)) in names:
            filters.append(F.col(place) == F.col(names[name]))
        else:
            names[name] = place
    df = reduce(DataFrame.where, filters, triples)
    return Bound(df.select(*[F.col(place).alias(name) for name, place in names.items()]), dict.fromkeys(names, FULL))


def join_bound(a: Bound, b: Bound) -> Bound:
    """Joins on raw keys where both sides read a variable by the same template, and on full terms otherwise."""
    shared = [n for n in a.terms if n in b.terms]
    if not shared:
        if not b.terms:
            return Bound(a.df.crossJoin(b.df.limit(1)), a.terms)
        return Bound(a.df.crossJoin(b.df), a.terms | b.terms)
    for n in shared:
        if a.terms[n] != b.terms[n]:
            a = Bound(a.df.withColumn(n, a.full(n)), a.terms | {n: FULL})
            b = Bound(b.df.withColumn(n, b.full(n)), b.terms | {n: FULL})
    return Bound(a.df.join(b.df, shared, "inner"), a.terms | b.terms)


def join_all(parts: list[tuple[Part, Bound]]) -> Bound:
    """Left-deep, in the order of join_order. Parts without variables are gates: they let all rows pass or none."""
    gates = [b for _, b in parts if not b.terms]
    rest = [(p, b) for p, b in parts if b.terms]
    if not rest:
        return Bound(reduce(lambda a, b: a.crossJoin(b), [b.df.limit(1) for b in gates]), {})
    order = join_order([p for p, _ in rest])
    return reduce(join_bound, [*[rest[k][1] for k in order], *gates])


def project(bound: Bound, names: tuple[str, ...]) -> DataFrame:
    """The named variables as full terms; a bag, without distinct."""
    return bound.df.select(*[bound.full(n).alias(n) for n in names])


# --- the virtual graph ---------------------------------------------------------------------------------------------


def _shape(side: Side) -> tuple:
    return ("constant", side.constant) if side.constant is not None else (side.term.kind, side.term.prefix)


def _viable(graph: RelationalGraph, pattern: TriplePattern) -> list[Mapping]:
    out = []
    for m in graph.mapped:
        if not is_variable(pattern.p) and m.predicate != pattern.p:
            continue
        if all(is_variable(t) or side.match(t) is not None for t, side in ((pattern.s, m.s), (pattern.o, m.o))):
            out.append(m)
    return out


def viable_mappings(graph: RelationalGraph, patterns: tuple[TriplePattern, ...]) -> list[list[Mapping]]:
    """For each pattern the mappings that can give it solutions, given what the other patterns can bind.

    Mappings go whose subject or object can't be what another pattern binds the variable to, until nothing changes.
    """
    viable = [_viable(graph, t) for t in patterns]
    while True:
        before = [len(v) for v in viable]
        allowed: dict[str, set] = {}
        for t, ms in zip(patterns, viable):
            for k, place in ((0, t.s), (1, t.p), (2, t.o)):
                if is_variable(place):
                    shapes = {(_shape(m.s), ("constant", m.predicate), _shape(m.o))[k] for m in ms}
                    name = variable_name(place)
                    allowed[name] = shapes if name not in allowed else allowed[name] & shapes
        ok = lambda term, shape: not is_variable(term) or shape in allowed[variable_name(term)]
        viable = [
            [m for m in ms if ok(t.s, _shape(m.s)) and ok(t.o, _shape(m.o)) and ok(t.p, ("constant", m.predicate))]
            for t, ms in zip(patterns, viable)
        ]
        if [len(v) for v in viable] == before:
            return viable


def _filters(pattern: TriplePattern, m: Mapping) -> list[Column]:
    out = []
    for term, side in ((pattern.s, m.s), (pattern.o, m.o)):
        if not is_variable(term):
            out.append(side.match(term))
        elif side.constant is None:
            out.append(F.expr(side.expr).isNotNull())
    if is_variable(pattern.s) and pattern.s == pattern.o:
        out.append(m.s.raw() == m.o.raw() if m.s.term == m.o.term else m.s.term.full(m.s.raw()) == m.o.term.full(m.o.raw()))
    return out


def _scan_star(graph: RelationalGraph, patterns: list[TriplePattern], ms: list[Mapping]) -> Bound:
    """Patterns with one subject over rows of one table: a single scan, without a join.

    Only patterns whose mapping is functional come together, so a subject's row has all its objects.
    """
    df = graph.table(ms[0].table)
    columns: dict[str, Column] = {}
    terms: dict[str, Term] = {}
    for t, m in zip(patterns, ms):
        df = reduce(DataFrame.where, _filters(t, m), df)
        for term, raw, kind in ((t.s, m.s.raw(), m.s.term), (t.o, m.o.raw(), m.o.term), (t.p, F.lit(m.predicate), FULL)):
            if is_variable(term) and variable_name(term) not in terms:
                columns[variable_name(term)], terms[variable_name(term)] = raw, kind
    df = df.select(*[c.alias(n) for n, c in columns.items()])
    return Bound(df if ms[0].unique else df.distinct(), terms)


def _scan_union(graph: RelationalGraph, pattern: TriplePattern, ms: list[Mapping]) -> Bound:
    """Branches of one pattern. Where all read a variable by one template it stays raw. The branches give different
    triples, so the union of their sets is a set."""
    if len(ms) > 1 and pattern.mask == "VVV" and len(pattern.variables) == 3:
        names = pattern.variables
        return Bound(graph.rows_of(ms).toDF(*names), dict.fromkeys(names, FULL))
    parts = [_scan_star(graph, [pattern], [m]) for m in ms]
    if not parts:
        return graph.empty(dict.fromkeys(pattern.variables, FULL))
    if len(parts) == 1:
        return parts[0]
    terms = {n: parts[0].terms[n] if len({p.terms[n] for p in parts}) == 1 else FULL for n in parts[0].terms}
    selected = [p.df.select(*[(F.col(f"`{n}`") if terms[n] == p.terms[n] else p.full(n)).alias(n) for n in terms]) for p in parts]
    return Bound(reduce(DataFrame.unionByName, selected), terms)


def _fusable(a: tuple[TriplePattern, list[Mapping]], b: tuple[TriplePattern, list[Mapping]]) -> bool:
    (t, ms), (u, ns) = a, b
    if len(ms) != 1 or len(ns) != 1 or t.s != u.s or not is_variable(t.s):
        return False
    m, n = ms[0], ns[0]
    objects = [x for x in (t.o, u.o) if is_variable(x)]
    own = len(set(objects)) == len(objects) and t.s not in objects
    return own and m.table == n.table and m.s == n.s and m.functional and n.functional and not is_variable(t.p) and not is_variable(u.p)


def _estimate(graph: RelationalGraph, t: TriplePattern, ms: list[Mapping], bound: Bound) -> Part:
    """Rows from file sizes. A subject's values are as many as rows; an object's as many as its class has instances."""
    rows = sum(size_of(graph.table(m.table)) for m in {m.table: m for m in ms}.values()) / ROW_BYTES
    for term, side in ((t.s, "s"), (t.o, "o")):
        if not is_variable(term) and any(getattr(m, side).constant is None for m in ms):
            rows *= SELECTIVITY
    distinct = dict.fromkeys(bound.terms, max(rows, 1.0))
    if is_variable(t.o):
        homes = {ENTITIES[m.range][0] for m in ms if m.range}
        if homes:
            distinct[variable_name(t.o)] = min(max(rows, 1.0), sum(size_of(graph.table(x)) for x in homes) / ROW_BYTES)
    return Part(max(rows, 1.0), distinct)


def evaluate_items(
    graph: RelationalGraph, query: BGPQuery, items: list[tuple[TriplePattern, list[Mapping]]], estimate: Callable[[int, Bound], Part], narrow: Collection[int] = ()
) -> DataFrame:
    """Solutions of patterns with their mappings. estimate: rows and distinct terms of the k-th pattern; narrow: patterns
    with so few rows that they are broadcast."""
    groups: list[list[int]] = []
    for k, item in enumerate(items):
        home = next((g for g in groups if all(_fusable(items[j], item) for j in g)), None)
        home.append(k) if home is not None else groups.append([k])
    parts = []
    for g in groups:
        if len(g) == 1:
            bound = _scan_union(graph, *items[g[0]])
        else:
            bound = _scan_star(graph, [items[k][0] for k in g], [items[k][1][0] for k in g])
        if any(k in narrow for k in g):
            bound = Bound(F.broadcast(bound.df), bound.terms)
        own = [estimate(k, bound) for k in g]
        rows = min(p.rows for p in own)
        parts.append((Part(rows, {v: min(rows, *(p.distinct.get(v, rows) for p in own)) for v in bound.terms}), bound))
    return project(join_all(parts), query.projected)


def evaluate_relational(graph: RelationalGraph, query: BGPQuery) -> DataFrame:
    items = list(zip(query.patterns, viable_mappings(graph, query.patterns)))
    return evaluate_items(graph, query, items, lambda k, bound: _estimate(graph, *items[k], bound))


def evaluate_triples(triples: DataFrame, query: BGPQuery, rows: dict[str, float] | None = None) -> DataFrame:
    """Over (s, p, o). rows: row counts by predicate, for the join order."""
    rows = rows or {}
    every = sum(rows.values()) or 1e6
    parts = []
    for t in query.patterns:
        n = rows.get(t.p, 0.0 if rows else every) if not is_variable(t.p) else every
        n *= SELECTIVITY ** sum(not is_variable(x) for x in (t.s, t.o))
        parts.append((Part.of(n, *t.variables), scan_triples(triples, t)))
    return project(join_all(parts), query.projected)


def evaluate(source: RelationalGraph | DataFrame, text: str) -> DataFrame:
    """The solutions of a SPARQL query, one column of terms for each selected variable."""
    query = parse(text)
    if isinstance(source, RelationalGraph):
        return evaluate_relational(source, query)
    return evaluate_triples(source, query)
