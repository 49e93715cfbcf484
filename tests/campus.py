"""The hand fixture: 33 triples of a small campus, its schema, and a nested-loop evaluator to hold answers against."""

from __future__ import annotations

from tessera.functions.terms import RDF_TYPE, is_variable, variable_name
from tessera.plans.sparql import parse


def ex(name: str) -> str:
    return f"<http://ex.org/{name}>"


_TYPES = {
    "Univ": "u1 u2", "Dept": "d1 d2", "Prof": "p1 p2", "Person": "p1", "Course": "c1 c2", "Grad": "g1 g2 g3", "Pub": "pub1",
}
_EDGES = """d1 subOrgOf u1 | d2 subOrgOf u2 | p1 worksFor d1 | p2 worksFor d2 | p1 teaches c1 | p2 teaches c2
 | g1 memberOf d1 | g2 memberOf d2 | g1 degreeFrom u1 | g2 degreeFrom u1 | g1 advisor p1 | g2 advisor p2
 | g1 takes c1 | g2 takes c1 | pub1 author p1 | x1 takes c2"""
_NAMES = {"g1": '"Ann Lee"@en', "g2": '"Bob"', "g3": '"Cy"', "p1": '"Dr. O\'Neil"'}
_SCHEMA = """Grad memberOf Dept | Dept subOrgOf Univ | Grad degreeFrom Univ | Grad advisor Prof | Prof worksFor Dept
 | Prof teaches Course | Grad takes Course | Pub author Prof | Prof subClassOf Person"""

TRIPLES = (
    [(ex(i), RDF_TYPE, ex(c)) for c, own in _TYPES.items() for i in own.split()]
    + [tuple(map(ex, e.split())) for e in _EDGES.split("|")]
    + [(ex(s), ex("name"), o) for s, o in _NAMES.items()]
)
SCHEMA = [tuple(map(ex, e.split())) for e in _SCHEMA.split("|")]
PREFIX = "PREFIX ex: <http://ex.org/>\n"


def brute(triples: list[tuple[str, str, str]], text: str) -> list[tuple[str, ...]]:
    """The bag of solutions by nested loops over a set of triples, sorted."""
    query = parse(text)
    found: list[dict[str, str]] = [{}]
    for t in query.patterns:
        step = []
        for b in found:
            for triple in set(triples):
                own = dict(b)
                for term, value in zip(t.terms, triple):
                    if not is_variable(term):
                        if term != value:
                            break
                    elif own.setdefault(variable_name(term), value) != value:
                        break
                else:
                    step.append(own)
        found = step
    return sorted(tuple(b[v] for v in query.projected) for b in found)
