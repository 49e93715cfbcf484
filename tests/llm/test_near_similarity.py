"""The pipeline's near-duplicate stage against brute force over exact Jaccard similarities."""

import random

import numpy as np

from tessera.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(texts):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i in texts if root(i) == i}


def test_keep_one_at_similarity(spark):
    rng = random.Random(5)
    texts = {0: None, 1: "", 2: "Two words", 3: "two  WORDS", 4: "two words more"}
    for _ in range(12):
        first = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        texts[len(texts)] = " ".join(first)
        for _ in range(rng.randrange(12)):
            copy = list(first)
            for _ in range(rng.randrange(1, 2 + len(first) // 25)):
                copy[rng.randrange(len(copy))] = "changed"
            texts[len(texts)] = " ".join(copy)
    # a group linked in a chain: the first and the last have nothing in common
    long = [f"v{k}" for k in range(400)]
    for k in range(150):
        texts[len(texts)] = " ".join(long[2 * k : 2 * k + 100])
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, fp int")
    kept = simhash.keep_one_similar(docs)
    want = brute_kept(texts)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert {r.doc_id for r in simhash.keep_one_similar(docs, block=16).collect()} == want  # ten blocks, both passes
    assert len(want) < len(texts) - 170
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "A B"), (7, "a b"), (7, "c d")], "doc_id long, text string")
    assert sorted(simhash.keep_one_similar(odd).collect(), key=str) == sorted([(7, "a b"), (7, "c d")], key=str)


def test_large_group_in_linear_time(spark, monkeypatch):
    rng, base = random.Random(9), [f"w{k}" for k in range(200)]
    texts = {}
    for i in range(300):  # one word changed in each: every pair of copies is at 0.9 or more
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        texts[i] = " ".join(copy)
    texts[300] = " ".join(base[:70] + [f"y{k}" for k in range(60)] + base[:70])  # a candidate, perhaps, but not near
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    passes, compared = [], simhash._compared

    def counted(some, dealt, *names):
        passes.append(dealt.count())
        return compared(some, dealt, *names)

    monkeypatch.setattr(simhash, "_compared", counted)
    assert {r.doc_id for r in simhash.keep_one_similar(docs, block=10).collect()} == brute_kept(texts) == {0, 300}
    # in the first pass each copy goes to one task, those of one block to all; the second has the odd text at most
    assert passes[0] <= 300 + 40 * 40 and passes[1] <= 2 * 301
    passes.clear()
    assert simhash.keep_one_similar(docs).count() == 2 and len(passes) == 1


def test_set_links_against_brute_force():
    rng = random.Random(3)
    for n, size in ((1, 0), (2, 3), (40, 12), (60, 3000)):
        pool = [rng.randrange(2**64) for _ in range(max(1, size + size // 5))]
        sets = [set(rng.sample(pool, rng.randrange(size * 9 // 10, size + 1)) if size else ()) for _ in range(n)]
        found = simhash.set_links(np.arange(n), [np.array(sorted(x), np.uint64) for x in sets])
        label = list(range(n))
        for i in range(n):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    old, new = sorted((label[i], label[j]), reverse=True)
                    label = [new if x == old else x for x in label]
        want, got = label, list(range(n))
        for a, b in zip(*found):
            old, new = sorted((got[a], got[b]), reverse=True)
            got = [new if x == old else x for x in got]
        assert got == want


def test_near_stage_takes_the_trees_links(spark, monkeypatch):
    """The vantage-point tree over SimHash fingerprints finds near copies that no band gives, and they are compared."""
    import corpus_pipeline

    base = [f"w{k}" for k in range(2000)]
    texts = {1: " ".join(base), 2: " ".join([*base[:-1], "x"]), 3: " ".join(f"v{k}" for k in range(90)), 4: "w1 w2"}
    prints = [simhash.hashes_fingerprint(np.unique(simhash.shingle_hashes(texts[i].encode(), 5))) for i in (1, 2)]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.MAX_BITS
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(simhash, "band_edges", lambda firsts: firsts.select("fp", "fp").toDF("a", "b").limit(0))
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {1, 3, 4}
