"""The pipeline's stages, chained by hand with brute-force versions, against run()."""

import corpus_pipeline
import pytest
from test_near_and_lines import brute_lines
from test_near_similarity import brute_kept
from test_text_operators import brute_counts, sellers

from tessera.llm import decontaminate, packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(at / name))
        docs = spark.read.parquet(str(at / name))
        out.append(docs)
    return out


def test_stages(spark, staged):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text for r in source.collect()}
    good = {}
    for i, t in docs.items():
        n, _, _, _, repeat = brute_counts(t)
        if n >= 10 and 100 * repeat <= 20 * n:
            good[i] = t
    assert {r.doc_id: r.text for r in staged[0].collect()} == good  # no host of this table is rejected
    assert len(good) < len(docs)

    gone = brute_lines(sorted(good.items()), 50)
    kept = {}
    for i, t in good.items():
        lines = t.split("\n")
        rest = [ln for p, ln in enumerate(lines) if (i, p) not in gone]
        if len(rest) == len(lines) or rest:
            kept[i] = "\n".join(rest)
    assert gone and {r.doc_id: (r.text, r.n_chars) for r in staged[1].collect()} == {i: (t, len(t)) for i, t in kept.items()}

    alone = brute_kept(kept)
    single = {i: t for i, t in kept.items() if i in alone}
    assert {r.doc_id for r in staged[2].collect()} == set(single)

    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r.doc_id for r in staged[3].collect()}
    for i, t in single.items():
        text = decontaminate.normal(t)
        exact = any(b in text for b in bench)
        assert not (exact and i in found)
        if i not in found and not exact:
            assert any(sellers(b, text) <= decontaminate.budget(b) for b in bench)

    assert all(s.columns == source.columns for s in staged[:-1])
    encode = packing.encoder(packing.default_tokenizer())
    tokens = {i: len(encode(t)) + 1 for i, t in single.items() if i in found}
    sums, rows = {}, staged[4].collect()
    for r in rows:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == tokens
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, rows))


def test_empty_table_and_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    fine = "a perfectly fine text of more than ten different words in all its length"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 3), (2, fine, None, None, None), (3, "", "en", "s", 0), (4, fine, "en", "s", 9)], schema)
    for docs, want in ((empty, []), (odd, [2])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.names
        assert [r.doc_id for r in docs.collect()] == want
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
