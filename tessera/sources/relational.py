"""A direct mapping of relational Parquet tables to triples, kept virtual.

A predicate maps to two columns of one table. Terms stay raw keys until the end: a scan binds a variable to a key
column and remembers the IRI template, so joins compare keys of the table's own type, constants become filters on the
key that Parquet can push down, and a constant that no template can make prunes its branch.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.terms import RDF_TYPE, quote

BASE = "http://ex.org/"


def iri(name: str) -> str:
    return f"<{BASE}{name}>"


@dataclass(frozen=True)
class Term:
    """How a column's raw values read as terms: '' + value with prefix and suffix, a quoted literal, or the term itself."""

    kind: str  # iri, literal, term
    prefix: str = ""

    def full(self, raw: Column) -> Column:
        if self.kind == "iri":
            return F.concat(F.lit(f"<{self.prefix}"), raw.cast("string"), F.lit(">"))
        return quote(raw.cast("string")) if self.kind == "literal" else raw


FULL = Term("term")


@dataclass(frozen=True)
class Side:
    """Subject or object of a mapping: an expression over the table, or a constant term."""

    term: Term
    expr: str = ""
    constant: str | None = None
    keys: tuple[str, ...] = ()  # the integer columns that make up the key, with '-' between

    def raw(self) -> Column:
        return F.lit(self.constant) if self.constant is not None else F.expr(self.expr)

    def match(self, value: str) -> Column | None:
        """The filter under which this side is the constant `value`; None if it never is."""
        if self.constant is not None:
            return F.lit(True) if value == self.constant else None
        if self.term.kind == "literal":
            if not value.startswith('"') or not value.endswith('"') or len(value) < 2:
                return None
            plain = value[1:-1]
            if "\\" in plain:
                return self.term.full(F.expr(self.expr)) == value
            return F.expr(self.expr) == F.lit(plain)
        head = f"<{self.term.prefix}"
        if not (value.startswith(head) and value.endswith(">")):
            return None
        local = value[len(head) : -1]
        if not self.keys:
            return F.expr(self.expr) == F.lit(local)
        parts = local.split("-")
        if len(parts) != len(self.keys) or not all(p.isascii() and p.isdigit() and str(int(p)) == p for p in parts):
            return None
        return reduce(lambda a, b: a & b, [F.col(k) == F.lit(int(p)) for k, p in zip(self.keys, parts)])


@dataclass(frozen=True)
class Mapping:
    predicate: str
    table: str
    s: Side
    o: Side
    unique: bool = True  # no pair of terms comes twice
    functional: bool = True  # a subject has one row, or one object in all its rows
    domain: str = ""
    range: str = ""


def _key(name: str, *columns: str) -> Side:
    expr = columns[0] if len(columns) == 1 else f"concat_ws('-', {', '.join(columns)})"
    return Side(Term("iri", f"{BASE}{name}/"), expr, keys=columns)


def _named(name: str, expr: str) -> Side:
    return Side(Term("iri", f"{BASE}{name}/"), expr)


def _text(expr: str) -> Side:
    return Side(Term("literal"), expr)


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_BRAND, _SEGMENT = "replace(p_brand, '#', '_')", "c_mktsegment"

#: class -> table, subject, whether its rows are unique
ENTITIES: dict[str, tuple[str, Side, bool]] = {
    "Region": ("region", _key("region", "r_regionkey"), True),
    "Nation": ("nation", _key("nation", "n_nationkey"), True),
    "Customer": ("customer", _key("customer", "c_custkey"), True),
    "Supplier": ("supplier", _key("supplier", "s_suppkey"), True),
    "Part": ("part", _key("part", "p_partkey"), True),
    "Order": ("orders", _key("order", "o_orderkey"), True),
    "Lineitem": ("lineitem", _key("lineitem", *_LINE), False),
    "Event": ("events", _key("event", "event_id"), True),
    "Segment": ("customer", _named("segment", _SEGMENT), False),
    "Brand": ("part", _named("brand", _BRAND), False),
}

#: class, predicate, object, class of the object or '' for a literal
PROPERTIES: list[tuple[str, str, Side, str]] = [
    ("Region", "name", _text("r_name"), ""),
    ("Nation", "inRegion", _key("region", "n_regionkey"), "Region"),
    ("Nation", "name", _text("n_name"), ""),
    ("Customer", "inNation", _key("nation", "c_nationkey"), "Nation"),
    ("Customer", "inSegment", _named("segment", _SEGMENT), "Segment"),
    ("Customer", "name", _text("c_name"), ""),
    ("Supplier", "inNation", _key("nation", "s_nationkey"), "Nation"),
    ("Supplier", "name", _text("s_name"), ""),
    ("Part", "hasBrand", _named("brand", _BRAND), "Brand"),
    ("Part", "name", _text("p_name"), ""),
    ("Part", "type", _text("p_type"), ""),
    ("Part", "size", _text("cast(p_size as string)"), ""),
    ("Order", "placedBy", _key("customer", "o_custkey"), "Customer"),
    ("Order", "status", _text("o_orderstatus"), ""),
    ("Order", "priority", _text("o_orderpriority"), ""),
    ("Lineitem", "ofOrder", _key("order", "l_orderkey"), "Order"),
    ("Lineitem", "ofPart", _key("part", "l_partkey"), "Part"),
    ("Lineitem", "suppliedBy", _key("supplier", "l_suppkey"), "Supplier"),
    ("Lineitem", "returnflag", _text("l_returnflag"), ""),
    ("Lineitem", "linestatus", _text("l_linestatus"), ""),
    ("Event", "byUser", _key("customer", "user_id"), "Customer"),
    ("Event", "event_type", _text("event_type"), ""),
]


def mappings() -> list[Mapping]:
    out = [
        Mapping(RDF_TYPE, table, subject, Side(FULL, constant=iri(name)), unique, True, name)
        for name, (table, subject, unique) in ENTITIES.items()
    ]
    for name, predicate, target, to in PROPERTIES:
        table, subject, unique = ENTITIES[name]
        functional = unique or name == "Lineitem" and bool(to)  # these objects are parts of the key
        out.append(Mapping(iri(predicate), table, subject, target, unique, functional, name, to))
    return out


@dataclass
class Bound:
    """Solutions: a column for each variable with raw values, and how each reads as terms."""

    df: DataFrame
    terms: dict[str, Term] = field(default_factory=dict)

    def full(self, name: str) -> Column:
        return self.terms[name].full(F.col(f"`{name}`"))


class RelationalGraph:
    """The virtual graph over the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, mapped: list[Mapping] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.mapped = mapped or mappings()
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def predicates(self) -> list[str]:
        return list(dict.fromkeys(m.predicate for m in self.mapped))

    def _rows(self, ms: list[Mapping]) -> DataFrame:
        """(s, p, o) of mappings with one subject side: one scan, and where rows may repeat one distinct over raw keys."""
        side = ms[0].s
        keys = [F.col(k) for k in side.keys] or [side.raw().alias("__s")]
        df = self.table(ms[0].table).select(*keys, *[m.o.raw().alias(f"__o{k}") for k, m in enumerate(ms)])
        df = df if ms[0].unique else df.distinct()
        subject = side.term.full(F.expr(side.expr) if side.keys else F.col("__s"))
        each = [F.struct(F.lit(m.predicate).alias("p"), m.o.term.full(F.col(f"__o{k}")).alias("o")) for k, m in enumerate(ms)]
        return df.select(subject.alias("s"), F.explode(F.array(*each)).alias("t")).select("s", "t.*").where("s is not null and o is not null")

    def triples(self, *only: str) -> DataFrame:
        """(s, p, o) of all predicates, or of those named. A set without a distinct over the whole: mappings don't overlap.

        Rows with a null key or value make no triple.
        """
        return self.rows_of([m for m in self.mapped if not only or m.predicate in only])

    def rows_of(self, ms: list[Mapping]) -> DataFrame:
        """(s, p, o) of some mappings, a scan for each table and subject."""
        groups: dict[tuple, list[Mapping]] = {}
        for m in ms:
            alone = None if m.unique or m.functional else m.predicate
            groups.setdefault((m.table, m.s, alone), []).append(m)
        return reduce(DataFrame.unionByName, [self._rows(own) for own in groups.values()])

    def schema_triples(self) -> DataFrame:
        """(s, p, o) of the classes: domain, predicate, range."""
        rows = [(iri(m.domain), m.predicate, iri(m.range)) for m in self.mapped if m.range]
        return self.spark.createDataFrame(rows, "s string, p string, o string")

    def empty(self, terms: dict[str, Term]) -> Bound:
        fields = ", ".join(f"`{n}` string" for n in terms) or "`_` string"
        df = self.spark.range(0).select(*[F.lit("").alias(n) for n in terms]) if terms else self.spark.createDataFrame([], fields)
        return Bound(df, dict.fromkeys(terms, FULL))
