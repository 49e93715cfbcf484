"""Answers queries from a partitioned store: partition discovery, pruned scans, warm and cold runs, and their log."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.terms import is_variable, table_name, variable_name
from tessera.operators.bgp import evaluate_items, join_all, project, scan_triples, viable_mappings
from tessera.operators.store import BROADCAST_ROWS, Store
from tessera.plans.order import Part, join_order, spanning_conditions
from tessera.plans.sparql import BGPQuery, TriplePattern, discovery_terms, parse
from tessera.sources.ntriples import list_files


@dataclass
class Run:
    query: str
    seconds: float
    load_seconds: float
    loaded_rows: int
    result_count: int
    patterns: int
    partitions: list[int | None]


class Engine:
    def __init__(self, store: Store):
        self.store = store
        self.spark: SparkSession = store.spark
        self._rows: dict[int, int] | None = None
        self._warm: dict[tuple, DataFrame] = {}

    # --- discovery ---

    def partition_rows(self) -> dict[int, int]:
        if self._rows is None:
            rows = self.store.stats.groupBy("part_id").agg(F.sum("rows").alias("n")).collect()  # as many rows as partitions
            self._rows = {r.part_id: r.n for r in rows}
        return self._rows

    def discover(self, query: BGPQuery) -> dict[int, int | None]:
        """Pattern number -> the smallest partition that answers it, or None if all partitions must be read.

        All terms are looked up in one pass over each index. A class names its partitions; a constant those that all
        of its classes share, or else those of any of them.
        """
        terms = discovery_terms(query)
        wanted = sorted(set(terms.values()))
        if not wanted:
            return dict.fromkeys(range(len(query.patterns)))
        typed = self.store.classes_of(wanted)
        classes = sorted(set(wanted).union(*typed.values()))
        parts: dict[str, set[int]] = {}
        for r in self.store.class_index.where(F.col("class").isin(classes)).collect():
            parts.setdefault(r["class"], set()).add(r.part_id)
        rows = self.partition_rows()

        def smallest(term: str) -> int | None:
            if term in parts:
                found = parts[term]
            else:
                each = [parts[c] for c in sorted(typed.get(term, ())) if c in parts]
                found = set.intersection(*each) or set.union(*each) if each else set()
            return min(found, key=lambda k: (rows.get(k, 0), k)) if found else None

        return {k: smallest(terms[k]) if k in terms else None for k in range(len(query.patterns))}

    def pruned_predicates(self, pattern: TriplePattern, part: int) -> list[str] | None:
        """For an unbound predicate: the predicates that the vertical index has for the constant end."""
        if not is_variable(pattern.p):
            return None
        for term, role in ((pattern.s, "s"), (pattern.o, "o")):
            if term.startswith("<"):
                return self.store.predicates_of(term, role, part)
        return None

    # --- scans ---

    def source(self, pattern: TriplePattern, part: int | None) -> DataFrame:
        """The triples to scan: one partition, and of it the vertical partitions that matter. Without a partition all
        are read; a triple is there once."""
        df = self.store.held if part is None else self.store.partition(part)
        if not is_variable(pattern.p):
            df = df.where(F.col("p") == pattern.p)
        if part is None:
            for place, value in (("s", pattern.s), ("o", pattern.o)):
                if not is_variable(value):
                    df = df.where(F.col(place) == value)
            return df.select("s", "p", "o")
        names = self.pruned_predicates(pattern, part)
        if names is not None:
            df = df.where(F.col("p").isin(names) if names else F.lit(False))
        return df.select("s", "p", "o")

    def estimates(self, query: BGPQuery, parts: dict[int, int | None]) -> list[Part]:
        """For each pattern its rows and distinct terms, from the stored statistics of the tables that it reads."""
        stats = {(r.part_id, r.p): r for r in self.store.stats.where(F.col("p").isin([t.p for t in query.patterns])).collect()}
        total = self.partition_rows()
        out = []
        for k, t in enumerate(query.patterns):
            own = [parts[k]] if parts[k] is not None else list(total)
            if is_variable(t.p):
                n = subjects = objects = float(sum(total.get(x, 0) for x in own))
            else:
                found = [stats[x, t.p] for x in own if (x, t.p) in stats]
                n, subjects, objects = (float(sum(r[c] for r in found)) for c in ("rows", "subjects", "objects"))
            if not is_variable(t.s):
                n /= max(subjects, 1.0)
            if not is_variable(t.o):
                n /= max(objects, 1.0)
            ends = {variable_name(v): min(d, max(n, 1.0)) for v, d in ((t.p, n), (t.o, objects), (t.s, subjects)) if is_variable(v)}
            out.append(Part(n, ends))
        return out

    def solutions(self, text: str, warm: bool = False) -> DataFrame:
        query = parse(text)
        parts = self.discover(query)
        rows = self.estimates(query, parts)
        if self.store.graph and not warm:
            return self.from_tables(query, parts, rows)
        bound = []
        for k, t in enumerate(query.patterns):
            df = self.cached(t, parts[k]) if warm else self.source(t, parts[k])
            bound.append((rows[k], scan_triples(df, t)))
        return project(join_all(bound), query.projected)

    def from_tables(self, query: BGPQuery, parts: dict[int, int | None], rows: list[Part]) -> DataFrame:
        """solutions from the tables by class: patterns on one subject are a scan, and joins are on raw keys. What the
        statistics say is narrow is broadcast."""
        graph, items = self.store.graph, []
        for k, (t, ms) in enumerate(zip(query.patterns, viable_mappings(graph, query.patterns))):
            if parts[k] is not None:
                ms = [x for m in ms if (x := graph.within(m, parts[k]))]
                names = self.pruned_predicates(t, parts[k])
                ms = ms if names is None else [m for m in ms if m.predicate in names]
            items.append((t, ms))
        narrow = {k for k, t in enumerate(query.patterns) if is_variable(t.s) and is_variable(t.o) and not is_variable(t.p) and rows[k].rows <= BROADCAST_ROWS}
        return evaluate_items(graph, query, items, lambda k, _: rows[k], narrow)

    # --- warm tables ---

    def cached(self, pattern: TriplePattern, part: int | None) -> DataFrame:
        key = (part, None if is_variable(pattern.p) else pattern.p, pattern.terms if is_variable(pattern.p) or part is None else None)
        if key not in self._warm:
            self._warm[key] = self.source(pattern, part).cache()
        return self._warm[key]

    def unload(self) -> None:
        """Drops the tables that this engine cached, and no others."""
        for df in self._warm.values():
            df.unpersist()
        self._warm.clear()

    # --- runs ---

    def run(self, text: str, name: str = "query", warm: bool = True, csv: str | None = None) -> Run:
        """A timed run. Warm: the tables are loaded first and the action is a count. Cold: nothing is cached, and with
        csv the action is writing the rows there."""
        query = parse(text)
        parts = self.discover(query)
        began, loaded = time.time(), 0
        if warm:
            loaded = sum(self.cached(t, parts[k]).count() for k, t in enumerate(query.patterns))
        load = time.time() - began if warm else 0.0
        df = self.solutions(text, warm)
        began = time.time()
        if csv:
            df.write.mode("overwrite").option("header", True).csv(csv)
            took = time.time() - began
            count = self.spark.read.option("header", True).csv(csv).count()
        else:
            count = df.count()
            took = time.time() - began
        return Run(name, took, load, loaded, count, len(query.patterns), [parts[k] for k in range(len(query.patterns))])

    def run_folder(self, folder: str, log: str | None = None, warm: bool = True) -> DataFrame:
        """All query files of a local folder; a first run warms the session up. log: a local file of JSON lines."""
        files = list_files(folder)
        if files and warm:
            self.run(Path(files[0]).read_text(), files[0], warm)
        runs = []
        for f in files:
            runs.append(asdict(self.run(Path(f).read_text(), f, warm)))
            self.unload()
        if log:
            Path(log).write_text("".join(json.dumps(r) + "\n" for r in runs))
        schema = "query string, seconds double, load_seconds double, loaded_rows long, result_count long, patterns int, partitions array<int>"
        return self.spark.createDataFrame(runs, schema)

    # --- the plan as text ---

    def translated(self, text: str, name: str = "query") -> str:
        """The plan as a text artifact: name, SQL over vertical partitions, their tables, and the number of patterns.

        FROM goes by join order; each variable is tied by N - 1 equalities round its smallest table.
        """
        query = parse(text)
        parts = self.discover(query)
        estimates = self.estimates(query, parts)
        rows = [e.rows for e in estimates]
        order = join_order(estimates)
        literal = lambda v: "'" + v.replace("'", "''") + "'"
        froms, tables = [], []
        for k in order:
            t = query.patterns[k]
            part = parts[k]
            table = table_name(part, t.p) if part is not None and not is_variable(t.p) else f"table{part:05d}" if part is not None else "placed"
            tables.append(table)
            chosen = [f"{c} AS {variable_name(v)}" for c, v in zip("spo", t.terms) if is_variable(v)] or ["1 AS one"]
            where = [f"{c} = {literal(v)}" for c, v in zip("spo", t.terms) if not is_variable(v) and c != "p"]
            froms.append(f"(SELECT {', '.join(chosen)} FROM {table}{' WHERE ' + ' AND '.join(where) if where else ''}) tab{k}")
        ties = []
        for v, own in query.patterns_of().items():
            names = [f"tab{k}" for k in sorted(own, key=lambda k: (rows[k], k))]
            ties += [f"{a}.{v} = {b}.{v}" for a, b in spanning_conditions(names, {f"tab{k}": rows[k] for k in own})]
        first = {v: next(k for k in order if v in query.patterns[k].variables) for v in query.projected}
        sql = f"SELECT {', '.join(f'tab{first[v]}.{v} AS {v}' for v in query.projected)} FROM {', '.join(froms)}"
        if ties:
            sql += " WHERE " + " AND ".join(ties)
        return f">>>>> {name}\nX {sql}\npartitions {','.join(dict.fromkeys(tables))}\nTP {len(query.patterns)}\n"


