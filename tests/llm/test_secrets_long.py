"""Secret scans of very long runs and of very many matches in one text, in linear time and without deep recursion."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import secrets

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def brute_entropy(word, n=secrets.WINDOW):
    return max(-sum(p * math.log2(p) for p in (w.count(c) / n for c in set(w))) for w in (word[k : k + n] for k in range(len(word) - n + 1)))


def test_entropy_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a" * 20, "ab" * 40, secrets.ALPHABET, secrets.ALPHABET[::-1] * 2]
    words += ["".join(rng.choice(ALNUM[: rng.randrange(1, 65)]) for _ in range(rng.randrange(20, 90))) for _ in range(150)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", secrets.window_entropy(F.col("w")).alias("h")).collect():
        assert r.h == pytest.approx(brute_entropy(r.w), abs=1e-9), r.w


def test_long_runs_and_many_matches(spark):
    rng = random.Random(4)
    keys = [hashlib.md5(str(k).encode()).hexdigest() for k in range(100_000)]
    texts = {
        "joined": "k " + "a-1-" * 250_000,
        "base64": "".join(rng.choice(ALNUM) for _ in range(1_000_000)),
        "keys": "é ".join(keys),
        "digits": "1" * 1_000_000,
    }
    spark.range(1).count()
    got = {}
    for name, text in texts.items():
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        got[name] = secrets.digest(secrets.find_secrets(docs)).collect()[0]
        assert time.perf_counter() - began < 60, name
    assert got["joined"].spans == "" or "entropy" in got["joined"].spans
    assert got["base64"].spans.endswith("entropy:0:1000000")
    found = [x for x in got["keys"].spans.split(",") if x.startswith("hex")]
    assert found == [f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", texts["keys"])] and got["keys"].n_hex == 100_000
    assert got["digits"].spans == "hex:0:1000000"
