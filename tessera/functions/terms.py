"""RDF terms in their N-Triples form: IRIs as <...>, literals from a double quote on. Equality is that of strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def mangle(term: Column) -> Column:
    """A name that is safe in files and tables. Different predicates may share one, so it is for display only."""
    return F.lower(F.regexp_replace(term, "[^A-Za-z0-9]", "_"))


def mangled(term: str) -> str:
    return re.sub("[^A-Za-z0-9]", "_", term).lower()


def partition_label(part: Column) -> Column:
    """Zero-padded to five digits; longer numbers stay whole."""
    text = part.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def table_name(part: int, predicate: str) -> str:
    return f"table{part:05d}_p_E_{mangled(predicate)}"


def is_variable(term: str) -> bool:
    """Only the first character tells: IRIs may hold question marks."""
    return term[:1] in "?$" and len(term) > 1


def is_literal_term(term: str) -> bool:
    return term.startswith('"')


def as_iri(term: str) -> str:
    """Wraps a bare IRI in angle brackets; variables, literals, blank nodes and IRIs stay."""
    return term if term[:1] in '?$<"_' else f"<{term}>"


def variable_name(term: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "", term)


def quote(text: Column) -> Column:
    """A plain literal; backslashes, quotes and line ends are escaped as in N-Triples."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def term_id(term: Column) -> Column:
    """A 64-bit id of a term: equal terms have equal ids. Operators join on the terms themselves."""
    return F.xxhash64(term)


def is_valid_triple(s: Column, p: Column, o: Column) -> Column:
    """Whether three terms make a triple: a resource, an IRI, and a resource or literal, none null or empty."""
    resource = lambda t: t.rlike(r"^(<[^>]*>|_:.+)$")
    return F.coalesce(resource(s) & p.rlike(r"^<[^>]*>$") & (resource(o) | is_literal(o)), F.lit(False))
