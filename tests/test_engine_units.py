"""Parser, join order, clustering, readers, functions, streaming; betweenness and patterns against brute force."""

import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campus import TRIPLES, brute, ex
from tessera.functions.terms import RDF_TYPE, as_iri, is_valid_triple, is_variable, mangle, mangled, partition_label, table_name, term_id
from tessera.operators import bgp, centrality
from tessera.operators.cluster import Ranked, assign_classes
from tessera.plans.order import Part, join_order, joined, spanning_conditions
from tessera.plans.sparql import SparqlSyntaxError, TriplePattern, UnsupportedSparql, discovery_terms, parse
from tessera.sources import files, ntriples
from tessera.sources.relational import RelationalGraph
from tessera.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


def test_parser_shapes():
    q = parse("SELECT ?X,?Y1 \r\nWHERE {?X a <http://e/C> .\r\n?X <http://e/p?q#r> ?Y1 . }\r\n")
    assert q.select == ("X", "Y1") and q.patterns == (TriplePattern("?X", RDF_TYPE, "<http://e/C>"), TriplePattern("?X", "<http://e/p?q#r>", "?Y1"))
    q = parse("PREFIX e: <http://e/>\nselect * where{http://e/s e:p ?o}")
    assert q.patterns == (TriplePattern("<http://e/s>", "<http://e/p>", "?o"),) and q.projected == ("o",)
    q = parse("PREFIX e : http://e/v#\nPREFIX : <http://e/>\nSELECT * WHERE {\n?s http://e/v#p ?o .\n?s e:q :C .\n}")
    assert q.patterns == (TriplePattern("?s", "<http://e/v#p>", "?o"), TriplePattern("?s", "<http://e/v#q>", "<http://e/C>"))
    q = parse('SELECT ?x WHERE { ?x <p> "a . b \\" }"@en-GB . ?x rdf:type ?y . # a comment . here\n ?x <q> "5"^^<http://t> }')
    assert [t.o for t in q.patterns] == ['"a . b \\" }"@en-GB', "?y", '"5"^^<http://t>'] and q.patterns[1].p == RDF_TYPE
    assert parse("SELECT ?x ?y { ?x <p> ?y.?y <q> <z> . . }").patterns[1] == TriplePattern("?y", "<q>", "<z>")
    assert parse("SELECT ?x WHERE { ?x ?p ?x }").patterns[0].variables == ("x", "p") and parse("SELECT ?x { ?x <p> _:b }").projected == ("x",)
    assert TriplePattern("?s", "<p>", '"x"').mask == "VCC" and parse("SELECT * { ?s <p> ?o . ?o <q> ?z }").patterns_of() == {"s": [0], "o": [0, 1], "z": [1]}


@pytest.mark.parametrize(
    "text",
    [
        "SELECT DISTINCT ?x { ?x <p> ?y }", "SELECT ?x { ?x <p> ?y FILTER(?y) }", "SELECT ?x { ?x <p> ?y . OPTIONAL { ?x <q> ?z } }",
        "ASK { ?x <p> ?y }", "SELECT ?x { ?x <p>/<q> ?y }", "SELECT ?x { ?x <p> ?y ; <q> ?z }", "SELECT ?x { ?x <p> ?y } LIMIT 3",
        "SELECT ?x { { ?x <p> ?y } UNION { ?x <q> ?y } }", "CONSTRUCT { ?x <p> ?y } WHERE { ?x <p> ?y }",
    ],
)
def test_unsupported(text):
    with pytest.raises(UnsupportedSparql):
        parse(text)


@pytest.mark.parametrize("text", ["", "SELECT ?x", "SELECT ?x { }", "SELECT ?x { ?x <p> }", "SELECT { ?x <p> ?y }", "SELECT ?z { ?x <p> ?y }", 'SELECT ?x { "a" <p> ?x }'])
def test_syntax_errors(text):
    with pytest.raises(SparqlSyntaxError):
        parse(text)


def test_discovery_terms():
    q = parse("PREFIX e: <http://e/> SELECT * { ?x a e:C . ?x e:p ?y . e:s e:q ?z . ?z e:r e:o . e:s a ?t . ?y e:n \"l\" . ?a ?b ?c }")
    e = "<http://e/{}>".format
    assert discovery_terms(q) == {0: e("C"), 1: e("C"), 2: e("s"), 3: e("o"), 4: e("s")}


def test_join_order():
    part = Part.of
    assert join_order([part(10, "a", "b"), part(5, "c", "d"), part(100, "b", "c")])[0] in (0, 1)
    assert join_order([part(3, "a"), part(1, "b"), part(2, "a")])[0] == 1  # components don't mix
    # a triangle: the nations tie many customers to many suppliers, so that join comes last
    triangle = [
        Part(15_000, {"c": 15_000, "n": 25}), Part(1_000, {"s": 1_000, "n": 25}), Part(150_000, {"o": 150_000, "c": 15_000}),
        Part(600_000, {"l": 600_000, "o": 150_000}), Part(600_000, {"l": 600_000, "s": 1_000}),
    ]
    order = join_order(triangle)
    assert abs(order.index(0) - order.index(1)) > 1 and {order[-1], order[-2]} != {0, 1}
    got = joined(Part(100, {"x": 10}), Part(50, {"x": 50, "y": 5}))
    assert got.rows == 100 and got.distinct == {"x": 10, "y": 5} and join_order([]) == []
    assert spanning_conditions(["t", "u", "v"], {"t": 100, "u": 2, "v": 10}) == [("u", "v"), ("t", "u")]


def test_clusters_cover_and_end():
    ranked = {"h": [Ranked("a", ("h", "a")), Ranked("b", ("h", "a", "b"))], "i": [Ranked("b", ("i", "b")), Ranked("a", ("i", "h", "a"))]}
    got = assign_classes(["h", "i"], ranked, {"a": 10, "b": 10, "h": 1, "i": 1, "zero": 0}, 22)
    assert set().union(*got.values()) == {"a", "b", "h", "i", "zero"} and all(got.values())
    huge = assign_classes(["h"], {"h": [Ranked("a", ("h", "a"))]}, {"a": 10**9}, 3)
    assert huge == {"h": {"h", "a"}}
    assert assign_classes(["h", "i"], {}, {}, 0) == {"h": {"h"}, "i": {"i"}}


def test_terms(spark):
    assert mangled("<http://Ex.org/a-B>") == "_http___ex_org_a_b_" and table_name(3, "<p>") == "table00003_p_E__p_"
    assert as_iri("http://x") == "<http://x>" and as_iri("?x") == "?x" and is_variable("?x") and not is_variable("<http://a?b>")
    row = spark.range(1).select(mangle(F.lit("<A-b>")).alias("m"), partition_label(F.lit(7)).alias("l"), partition_label(F.lit(1234567)).alias("n")).first()
    assert tuple(row) == ("_a_b_", "00007", "1234567")


def test_ntriples(spark, tmp_path):
    lines = ['# c', "", '<s> <p> "a b . c"@en .', "<s>\t<p>  <o> .  # end", '<s> <p> "q\\"x"^^<t>.', "junk", "_:b <p> _:c .", "<s> <p> <o> ."]
    (tmp_path / "a.nt").write_text("\n".join(lines))
    got = {tuple(r) for r in ntriples.read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    assert got == {("<s>", "<p>", '"a b . c"@en'), ("<s>", "<p>", "<o>"), ("<s>", "<p>", '"q\\"x"^^<t>'), ("_:b", "<p>", "_:c")}
    ntriples.write_ntriples(spark.createDataFrame(TRIPLES, "s string, p string, o string"), str(tmp_path / "out"))
    assert {tuple(r) for r in ntriples.read_ntriples(spark, str(tmp_path / "out")).collect()} == set(TRIPLES)
    (tmp_path / "schema").write_text("# s\nhttp://a http://p http://b\n<http://a>  http://p\thttp://c .\nbad line\n")
    assert {tuple(r) for r in ntriples.read_schema(spark, str(tmp_path / "schema")).collect()} == {
        ("<http://a>", "<http://p>", "<http://b>"), ("<http://a>", "<http://p>", "<http://c>"),
    }


def test_small_tables(spark, tmp_path):
    index = spark.createDataFrame([("<c>", 2), ("<c>", 0), ("<d>", 1)], "class string, part_id int")
    ntriples.write_pairs(ntriples.class_index_text(index), str(tmp_path / "index"))
    assert sorted(tuple(r) for r in ntriples.read_class_index(spark, str(tmp_path / "index")).collect()) == [("<c>", 0), ("<c>", 2), ("<d>", 1)]
    (tmp_path / "f").write_text("a\t5\nb\tx\n\nc\t7\n")
    assert sorted(tuple(r) for r in ntriples.read_pairs(spark, str(tmp_path / "f"), ("class", "n"), "long").collect()) == [("a", 5), ("c", 7)]
    assert len(ntriples.list_files(str(tmp_path))) > 1


def test_files(spark, tmp_path):
    base = str(tmp_path / "d")
    spark.range(3).write.parquet(f"{base}/a")
    spark.range(3).write.parquet(f"{base}/b")
    assert files.exists(spark, base) and files.names(spark, base) == ["a", "b"] and files.count_folders(spark, base) == 2 and files.size(spark, base) > 100
    assert files.move(spark, f"{base}/a", f"{base}/c") and files.remove(spark, f"{base}/b") and files.names(spark, base) == ["c"]
    assert not files.exists(spark, f"{base}/x") and files.names(spark, f"{base}/x") == [] and files.size(spark, f"{base}/x") == 0
    assert not files.remove(spark, f"{base}/x") and files.count_folders(spark, f"{base}/x") == 0
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "one").write_text("SELECT ?x { ?x <p> \"it's\" }")
    (tmp_path / "q" / "two").write_text("SELECT ?x { ?x <p> ?y . ?y <q> <z> }")
    (tmp_path / "q" / "bad").write_text("ASK { ?x <p> ?y }")
    got = files.queries_by_size(str(tmp_path / "q"))
    assert {k: [f.rsplit("/", 1)[1] for f in v] for k, v in got.items()} == {0: ["bad"], 1: ["one"], 2: ["two"]}
    assert [files.range_of(["b", "d"], k) for k in "abcde"] == [0, 1, 1, 2, 2]


def test_valid_triples(spark):
    rows = [("<s>", "<p>", "<o>"), ("_:b", "<p>", '"x'), ("s", "<p>", "<o>"), ("<s>", "_:p", "<o>"), ("<s>", "<p>", "o"), (None, "<p>", "<o>"), ("<s>", "<p>", "")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    got = df.select(is_valid_triple(F.col("s"), F.col("p"), F.col("o")).alias("v"), term_id(F.col("p")).alias("i")).collect()
    assert [r.v for r in got] == [True, True] + [False] * 5 and got[0].i == got[1].i != got[3].i


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<s> <p> <o> .\n<s> <p> <o> .\n")
    args = (str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check"))
    ingest(spark, *args).awaitTermination()
    (tmp_path / "in" / "b.nt").write_text('<s> <p> <o> .\n<s> <q> "x" .\n')
    ingest(spark, *args).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(args[1]).select("s", "p", "o").collect()) == [("<s>", "<p>", "<o>"), ("<s>", "<q>", '"x"')]


def brandes(edges):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, [])
        near.setdefault(b, [])
        if a != b:
            near[a].append(b)
            near[b].append(a)
    bc = dict.fromkeys(near, 0.0)
    for s in near:
        sigma, dist, order, before = dict.fromkeys(near, 0), {s: 0}, [], {v: [] for v in near}
        sigma[s], todo = 1, deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    n = len(near)
    return {v: (x / 2 / ((n - 1) * (n - 2) / 2) if n > 2 else 0.0) for v, x in bc.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_against_brandes(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}", f"p{rng.randrange(2)}") for _ in range(14)] + [("x", "y", "p"), ("y", "z", "p"), ("x", "x", "p")]
    edges = sorted(set(edges))
    got = {r.v: r.bc for r in centrality.betweenness(spark.createDataFrame(edges, "src string, dst string, pred string")).collect()}
    assert got == pytest.approx(brandes(edges))


TERMS = st.sampled_from(["<a>", "<b>", "<c>"])
SLOT = lambda names: st.one_of(st.sampled_from(names), TERMS)
PATTERN = st.tuples(SLOT(["?x", "?y", "?z"]), SLOT(["?p", "?x"]), st.one_of(SLOT(["?x", "?y", "?w"]), st.just('"l"')))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TERMS, TERMS, st.one_of(TERMS, st.just('"l"'))), min_size=1, max_size=12, unique=True), st.lists(PATTERN, min_size=1, max_size=3))
def test_random_patterns(spark, triples, patterns):
    if not any(is_variable(t) for p in patterns for t in p):
        patterns = [*patterns, ("?x", "?p", "?y")]
    text = "SELECT * { " + " . ".join(" ".join(p) for p in patterns) + " }"
    got = sorted(tuple(r) for r in bgp.evaluate(spark.createDataFrame(triples, "s string, p string, o string"), text).collect())
    assert got == brute(triples, text)


PREFIX = "PREFIX ex: <http://ex.org/>\n"
VIRTUAL = [
    "SELECT * { ?l ex:ofOrder ?o . ?l ex:returnflag ?f . ?o ex:placedBy <http://ex.org/customer/7> }",
    "SELECT * { ?l ex:ofOrder <http://ex.org/order/3> . ?l ex:linestatus ?f . ?l ex:returnflag ?g . ?l a ?t }",
    "SELECT * { <http://ex.org/part/3> ?p ?o }",
    'SELECT ?x { ?x ex:name "AFRICA" }',
    'SELECT ?x { ?x ex:size "7" . ?x ex:hasBrand ?b . ?b a ex:Brand }',
    "SELECT * { ?x ex:inSegment ?g . ?g a ex:Segment . ?x ex:inNation <http://ex.org/nation/03> }",
    "SELECT ?t { ?t a ?c . ?x a ?t }",
    "SELECT * { ?s ex:inRegion ?r . ?s ?p ?r }",
]


@pytest.mark.parametrize("text", VIRTUAL)
def test_virtual_graph_equals_triples(spark, text):
    own = RelationalGraph(spark, SF)
    names = ("name", "inRegion", "inSegment", "inNation", "hasBrand", "size", "ofOrder", "returnflag", "linestatus", "placedBy")
    triples = own.triples(RDF_TYPE, *[ex(n) for n in names]) if "?p " not in text else own.triples()
    got = sorted(tuple(r) for r in bgp.evaluate(own, PREFIX + text).collect())
    assert got == sorted(tuple(r) for r in bgp.evaluate(triples, PREFIX + text).collect())


def test_constants_are_pushed_down(spark):
    own = RelationalGraph(spark, SF)
    plan = bgp.evaluate(own, PREFIX + "SELECT ?m { ?o ex:placedBy <http://ex.org/customer/7> . ?o ex:status ?m }")._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan and "Join" not in plan.split("== Physical Plan ==")[1] and "o_totalprice" not in plan.split("== Physical Plan ==")[1]
