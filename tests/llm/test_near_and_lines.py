"""SimHash near-duplicates and line dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tessera.llm import line_dedup, simhash
from tessera.llm.common import connected_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    label = dict.fromkeys(fps)
    for i in fps:
        label[i] = i
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def near_texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)) for n in (400, 300, 60, 30, 5, 2, 1)]
    out = []
    for text in base:
        out += [text, text, text.upper()]
        words = text.split()
        for _ in range(6):
            own = list(words)
            own[rng.randrange(len(own))] = "changed"
            out.append("\t ".join(own))
    return out + ["", "  \n ", None, "é ü   x", "a" * 100_000, " ".join(WORDS * 2000)]


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    rows = [(k * 3 + 1, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")  # an extra column with a clashing name
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {i: g[0] for i, g in got.items()} == fps
    assert {i: g[1] for i, g in got.items()} == brute_components(fps)
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps).values())) and kept.columns == docs.columns


def test_tree_and_blocks_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = set(map(int, centers))
    for c in map(int, centers):
        for _ in range(12):
            c ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.add(c)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = connected_components(simhash.close_links(distinct, leaf=16, block=30, sample=1024, task=16)).collect()
    root = {r.node: r.root for r in links}
    f = np.array(fps, dtype=np.uint64)
    label = {s: s for s in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3)[0] + i + 1:
            a, b = find(signed[i]), find(signed[j])
            label[max(a, b)] = min(a, b)
    assert {s: root.get(s, s) for s in signed} == {s: find(s) for s in signed}
    tree = simhash.VantageTree(f[:512], 5)
    row, leaf = tree.leaves(f)
    homes = {}
    for r, k in zip(row, leaf):
        homes.setdefault(int(r), set()).add(int(k))
    for i in range(0, len(f), 7):
        for j in np.nonzero(np.bitwise_count(f ^ f[i]) <= 3)[0]:
            assert homes[i] & homes[int(j)]


def test_lower_levels_lose_no_link():
    rng = np.random.default_rng(6)
    for spread in (4, 64):  # close together, where no vantage point parts them, and apart
        centers = rng.integers(0, 2**63, 400, dtype=np.uint64) >> np.uint64(64 - spread)
        near = centers ^ np.left_shift(np.uint64(1), rng.integers(0, 63, 400).astype(np.uint64))
        fps = np.unique(np.concatenate([centers, near, near ^ np.uint64(5)]))
        parts = []
        for a, b in (simhash.tree_links(fps, leaf=8), simhash.leaf_links(fps)):
            root = {int(f): int(f) for f in fps}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in zip(a.tolist(), b.tolist()):
                x, y = sorted((find(x), find(y)))
                root[y] = x
            parts.append({f: find(f) for f in root})
        assert parts[0] == parts[1]


def test_shuffled_copies_stay_bounded():
    """Ten times the fingerprints: the copies that are dealt to tasks grow with the upper levels only, and those end."""
    rng = np.random.default_rng(8)
    copies = []
    for n in (2_000, 20_000, 200_000):
        fps = rng.integers(0, 2**63, n, dtype=np.uint64)
        depth = simhash.upper_depth(n, sample=512, task=64)
        tree = simhash.VantageTree(fps[:512], depth)
        copies.append(len(tree.leaves(fps)[0]) / n)
        # a task's leaf is split further on its own
    assert simhash.upper_depth(20_000, 512, 64) == simhash.upper_depth(200_000, 512, 64) == 5
    assert copies[2] < 1.1 * copies[1] < 8


def test_one_row_of_each_group_with_repeated_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long, "a"), (1, long, "b"), (2, long, "c"), (None, long, "d"), (3, "x y", "e"), (3, "other words", "f"), (3, "x y", "g"), (None, "only here", "h"), (None, "ONLY here", "i"), (5, None, "j"), (5, "", "k"), (4, "z", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for keep in (simhash.keep_one, simhash.keep_one_similar):
        got = sorted(((r.doc_id, (r.text or "").lower()) for r in keep(docs).collect()), key=str)
        assert got == sorted([(1, long), (3, "x y"), (3, "other words"), (None, "only here"), (5, ""), (4, "z")], key=str)


def test_near_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(None, "one two three four"), (7, "one two three four"), (7, "one two three four"), (None, None), (9, "other words entirely here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("7", "7"), ("7", "7"), ("9", "9"), ("None", "7"), ("None", "None")]


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(5, 3), (3, 5), (9, 9), (8, 2), (2, 1)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a != b:
            x = [k for k in label if label[k] in (label.get(a, a), label.get(b, b))] + [a, b]
            least = min([label.get(k, k) for k in x])
            label |= dict.fromkeys(x, least)
    assert got == label


def brute_lines(docs, least):
    """docs: (id, text), distinct ids in order. Which lines go, by all pairs of places."""
    line = [(i, p, ln) for i, t in docs for p, ln in enumerate((t or "").split("\n"))]
    gone = set()
    for b, (ib, pb, _) in enumerate(line):
        for a in range(b):
            n = words = 0
            while b + n < len(line) and line[a + n][2] == line[b + n][2] and line[a + n][0] == line[a][0] and line[b + n][0] == ib:
                words += len([w for w in line[b + n][2].replace("\t", " ").split(" ") if w])
                n += 1
            if words >= least:
                gone |= {(ib, pb + k) for k in range(n)}
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 3, 7, 12]))) for _ in range(14)]
    docs = []
    for i in range(30):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()}" for _ in range(rng.randrange(0, 25))]
        if docs and rng.random() < 0.4:
            lines += (rng.choice(docs)[1] or "").split("\n")
        docs.append((i - 5, "\n".join(lines)))
    docs.append((90, None))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, pos int, h string")
    out = line_dedup.dedup_lines(df, min_words=12)
    gone = brute_lines(docs, 12)
    got = {r.doc_id: (r.text, r.n_lines_in, r.n_lines_removed) for r in out.collect()}
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        kept = [ln for p, ln in enumerate(lines) if (i, p) not in gone]
        want = None if t is None else "\n".join(kept) if len(kept) < len(lines) else t
        assert got[i] == (want, len(lines), len(lines) - len(kept)), i
    assert gone and out.columns == ["doc_id", "text", "pos", "h", "n_lines_in", "n_lines_removed"]


def test_line_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    long = "word " * 60
    rows = [(3, long), (3, long), (None, long), (4, f"a\n{long}\nb"), (5, "x\n" * 500 + "y"), (6, "x\n" * 500 + "y"), (7, "z " * 30_000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_chars long")
    got = sorted((str(r.doc_id), r.n_lines_removed) for r in line_dedup.dedup_lines(df).collect())
    # the null id comes first and keeps its line; document 5 repeats itself: all but the first 50 words' run of lines goes
    assert got == [("3", 1), ("3", 1), ("4", 1), ("5", 499), ("6", 501), ("7", 0), ("None", 0)]
    kept = line_dedup.keep_with_text(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), len(r.text), r.n_chars) for r in kept.collect()) == [("4", 3, 3), ("5", 3, 3), ("7", 60_000, 9), ("None", 300, 9)]
