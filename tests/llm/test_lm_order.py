"""Scores of order 3 against brute force."""

import math
import random
from collections import Counter

import pytest

from tessera.llm import lm_score, queries


def brute(texts, order, alpha=lm_score.ALPHA):
    docs = [(t or "").encode().lower().split() for t in texts]
    grams = lambda d: Counter(tuple(d[k : k + n]) for n in range(1, order + 1) for k in range(len(d) - n + 1))
    own = [grams(d) for d in docs]
    whole = sum(own, Counter())
    for d, mine in zip(docs, own):
        rest, total, short = max(sum(map(len, docs)) - len(d), 1), 0.0, 0
        for k, w in enumerate(d):
            most = min(k, order - 1)
            for n in range(most, -1, -1):
                gram = tuple(d[k - n : k + 1])
                c = whole[gram] - mine[gram]
                if n == 0:
                    total += math.log10(max(c, 1) / rest)
                elif c:
                    total += math.log10(c / (whole[gram[:-1]] - mine[gram[:-1]]))
                if c or n == 0:
                    total += (most - n) * math.log10(alpha)
                    short += most > n
                    break
        yield len(d), short, total


@pytest.mark.parametrize("order", [3, 4])
def test_order_against_brute_force(spark, order):
    rng = random.Random(order)
    texts = [None, "", "Only", "the THE the", "a b c", "a b c"] + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chars in (10**9, 300):
        got = {r.doc_id: r for r in lm_score.score(docs, order=order, chunk_chars=chars).collect()}
        for k, (n, short, total) in enumerate(brute(texts, order)):
            assert (got[k].n_words, got[k].n_backoff) == (n, short) and got[k].log10_score == pytest.approx(total, abs=1e-4), texts[k]


def test_the_query_has_order_three(spark):
    rows = queries.queries()["op4_lm_score"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(texts, brute(texts.values(), 3)))
    assert len(rows) == len(texts) and all((r.n_words, r.n_backoff) == want[r.doc_id][:2] for r in rows)


def test_rows_that_repeat_id_and_text(spark):
    texts = ["a b c a b"] * 60 + ["a b d", None, None, ""]
    docs = spark.createDataFrame([(None if t == texts[0] else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    want = sorted((n, s, round(x, 3)) for n, s, x in brute(texts, 3))
    for chars in (10**9, 20):
        assert sorted((r.n_words, r.n_backoff, round(r.log10_score, 3)) for r in lm_score.score(docs, chunk_chars=chars).collect()) == want
