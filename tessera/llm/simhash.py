"""SimHash near-duplicates: fingerprints, and a vantage-point tree over them that finds every close pair.

The tree has two parts. Its upper levels are fitted on a bounded sample (about SAMPLE fingerprints by hash, twice that at
most; a documented parameter) and deal all fingerprints to leaves, one task each. A task goes on splitting its leaf, now
on all of the leaf's fingerprints, until LEAF or fewer are left; so the depth follows the data, while the copies that are
shuffled stop growing with the upper levels. Every fingerprint is indexed.

A node has a vantage point v and a radius mu. A fingerprint x with d(x, v) <= mu goes to the inner branch, others to
the outer. By the triangle inequality a partner within r of an inner x can lie in the outer branch only if
d(x, v) > mu - r, so just those boundary points are sent to the outer branch as well. Hence any two fingerprints
within r of each other meet in a leaf, and the pairs found in leaves are exact and complete.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, only, ship, small, tidy

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that the upper levels are fitted on; they end where a node has fewer than 16 of them.
SAMPLE = 65_536
#: Fingerprints of a leaf that a task searches without splitting it further, of a task that the upper levels aim at, and
#: the most that a task holds (8 bytes each) before its leaf is dealt in blocks.
LEAF, TASK, BLOCK = 1_024, 8_192, 4_194_304
#: Fingerprints that a split inside a task is chosen on.
CHOICE = 2_048
#: Of keep_one_similar: words of a shingle, and the least Jaccard similarity of near-duplicates.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: MinHash bands and rows: a pair at SIMILARITY shares no band with probability (1 - 0.8 ** 4) ** 32, about 5e-8.
BANDS, ROWS = 32, 4
#: Documents and shingles of a candidate group that one task compares before the group is dealt in blocks.
NEAR_BLOCK, NEAR_SHINGLES = 512, 1_000_000
#: Shingles that a task's incidence matrix has at once.
COLUMNS = 4_096


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a UTF-8 text's shingles in order. bytes.lower() and bytes.split() know ASCII only, as asked for."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype="<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    return hashes_fingerprint(shingle_hashes(text, shingle))


def hashes_fingerprint(h: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes: the bits that are 1 in over half of them."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        part = np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(part), 255):  # sums of up to 255 bits fit a byte
            ones += np.add.reduce(part[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) for every row of docs; a null text counts as empty, an empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).cast(pa.binary())
                fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    ship(docs.sparkSession)
    pair = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return pair.mapInArrow(run, "id long, fp long")


def best_split(own: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of eight candidates, the point and the distance with the least sum of squares of what the two branches get."""
    best = None
    for v in rng.choice(own, min(8, len(own)), replace=False):
        d = np.bitwise_count(own ^ v)
        within = np.cumsum(np.bincount(d, minlength=65))
        for mu in range(max(0, int(np.median(d)) - 2), min(64, int(np.median(d)) + 6)):
            outer = len(own) - (within[mu - radius] if mu >= radius else 0)
            cost = float(within[mu]) ** 2 + float(outer) ** 2
            if best is None or cost < best[0]:
                best = (cost, v, mu)
    return best[1], best[2]


class VantageTree:
    """A full binary tree in arrays: node k has the branches 2k+1 (inner) and 2k+2 (outer)."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = MAX_BITS, seed: int = 7):
        self.depth, self.radius = depth, radius
        n = 2**depth - 1
        self.points, self.mu = np.zeros(n, np.uint64), np.full(n, 32, np.int64)
        rng = np.random.default_rng(seed)
        held = {0: sample}
        for node in range(n):
            own = held.pop(node)
            if len(own):
                self.points[node], self.mu[node] = best_split(own, self.radius, rng)
            else:
                self.points[node] = rng.integers(0, 2**63, dtype=np.uint64)
            d = np.bitwise_count(own ^ self.points[node]).astype(np.int64)
            # the branches are fitted to what they get, the boundary's copies included
            held[2 * node + 1], held[2 * node + 2] = own[d <= self.mu[node]], own[d > self.mu[node] - self.radius]

    def leaves(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into fps, and for each the leaf; boundary points come more than once."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[row] ^ self.points[node]).astype(np.int64)
            inner = d <= self.mu[node]
            also = inner & (d > self.mu[node] - self.radius)
            node = np.concatenate([np.where(inner, 2 * node + 1, 2 * node + 2), 2 * node[also] + 2])
            row = np.concatenate([row, row[also]])
        return row, node - (2**self.depth - 1)


def leaf_links(fps: np.ndarray, radius: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of distinct fps under distance <= radius; fewer links than fps.

    Breadth first: each fingerprint is held against those not reached yet, so no list of pairs is made.
    """
    rest, a, b = fps, [], []
    while len(rest):
        todo, root, rest = [rest[0]], rest[0], rest[1:]
        while todo:
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            if near.any():
                found = rest[near]
                a.append(found)
                b.append(np.full(len(found), root))
                todo.extend(found)
                rest = rest[~near]
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return join(a), join(b)


def tree_links(fps: np.ndarray, radius: int = MAX_BITS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """leaf_links of distinct fps through the tree's lower levels, which are split depth first until `leaf` are left.

    Fingerprints that no vantage point parts well, since they all lie close together, are searched as they are.
    """
    rng, todo, a, b = np.random.default_rng(7), [fps], [], []
    while todo:
        own = todo.pop()
        if len(own) > leaf:
            v, mu = best_split(own if len(own) <= CHOICE else rng.choice(own, CHOICE, replace=False), radius, rng)
            d = np.bitwise_count(own ^ v)
            inner, outer = own[d <= mu], own[d > mu - radius]
            if max(len(inner), len(outer)) < 0.9 * len(own):
                todo += [inner, outer]
                continue
        found = leaf_links(own, radius)
        a.append(found[0])
        b.append(found[1])
    return np.concatenate(a), np.concatenate(b)


def upper_depth(n: int, sample: int = SAMPLE, task: int = TASK) -> int:
    """Levels that are fitted on the sample: as many as n fingerprints ask for, while the sample can tell them apart."""
    return max(0, min(math.ceil(math.log2(max(n, 1) / task)), int(math.log2(max(sample, 64) / 16))))


def close_links(distinct: DataFrame, radius: int = MAX_BITS, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp long) that give the same components as all pairs within radius.

    A leaf of the upper levels with more than `block` fingerprints is dealt into blocks, and each pair of blocks is a
    task of its own: no task holds more than about two blocks, and no pair is lost.
    """
    n = distinct.count()
    depth = upper_depth(n, sample, task)
    # a share of the fingerprints by hash, about `sample` of them
    share = F.xxhash64("fp") < F.lit(min(2**63 - 1, sample * 2**64 // max(n, 1) - 2**63))
    rows = distinct.where(share).select("fp").limit(2 * sample).collect() if depth else []
    tree = VantageTree(np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64), depth, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, node = tree.leaves(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fps[row])], names=["leaf", "fp"])

    ship(distinct.sparkSession)
    routed = distinct.select("fp").mapInArrow(route, "leaf long, fp long")
    # at most 2 ** depth leaves, which the sample's size bounds
    sizes = routed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = routed.join(F.broadcast(sizes), "leaf").withColumn("k", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    dealt = dealt.withColumn("o", other).select("leaf", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "fp")

    def links(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        a, b = tree_links(fps, radius, leaf)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """Row by row of docs: (id_col, fingerprint, component_id).

    component_id is the smallest id reachable over links of at most `radius` differing bits, the own id included.
    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part and get the
    smallest id of their component, null if it has none. Repeated rows and ids stay as rows. An empty table gives none.
    """
    fps = cut(fingerprints(only(docs, id_col, text_col), id_col, text_col, shingle))
    firsts = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    found = labelled(fps, firsts, close_links(firsts.select("fp"), radius))
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(fps: DataFrame, firsts: DataFrame, links: DataFrame) -> DataFrame:
    """fps(id, fp) with component_id, the least of firsts(fp, first) over links(a, b) between fps, and root, a
    fingerprint that names the component."""
    linked = connected_components(links)
    linked = linked.withColumnRenamed("node", "fp").join(firsts, "fp")
    component = linked.select("fp", "root").join(linked.groupBy("root").agg(F.min("first").alias("least")), "root")
    label = firsts.join(component, "fp", "left")
    label = label.select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # computed apart from the join, so that Spark can split the partition of a fingerprint that very many rows have
    return fps.join(cut(label), "fp")


def min_bands(h: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingle hashes: two sets share each with probability Jaccard ** ROWS."""
    factors = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
    times, plus = factors[0] * np.uint64(2) + np.uint64(1), factors[1]
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4_096):
        least = np.minimum(least, (np.multiply.outer(times, h[at : at + 4_096]) + plus[:, None]).min(axis=1))
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]


def _sets(docs: DataFrame, id_col: str, text_col: str, banded: bool) -> DataFrame:
    """(id, fp, size, and fingerprint and bands, or the set) for every row: fp is the hash of the text's set of 5-word
    shingles, fingerprint the SimHash of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, keys, sizes, prints, more, seen = batch.slice(at, 512), [], [], [], [], {}
                for text in part.column(1).cast(pa.binary()):
                    h = np.unique(shingle_hashes(text.as_py() or b"", NEAR_SHINGLE))
                    keys.append(key := xxhash.xxh3_64_intdigest(h.tobytes()))
                    sizes.append(len(h))
                    if banded and key not in seen:
                        seen[key] = hashes_fingerprint(h), np.array(min_bands(h), np.uint64).view(np.int64)
                    if banded:
                        prints.append(seen[key][0])
                    more.append(seen[key][1] if banded else h.tobytes())
                columns = [part.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
                if banded:
                    columns.append(pa.array(np.array(prints, np.uint64).view(np.int64)))
                columns.append(pa.array(more, pa.list_(pa.int64()) if banded else pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "size", *(("fingerprint", "bands") if banded else ("hashes",))])

    ship(docs.sparkSession)
    pair = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return pair.mapInArrow(run, "id long, fp long, size long, " + ("fingerprint long, bands array<long>" if banded else "hashes binary"))


def set_links(keys: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of sets under Jaccard >= least, by exact intersections of all pairs.

    The intersections are a product of the sets' incidence matrix with itself, some columns at a time; shingles of a
    single set can't be in one and have no column.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    _, terms, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[terms]
    owner, column = np.repeat(np.arange(len(sets)), sizes)[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        both += held @ held.T
    near = both >= least * (sizes[:, None] + sizes - both) - 1e-9
    label = np.arange(len(sets))
    for k in range(len(sets)):
        met = np.unique(label[near[k]])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    other = label != np.arange(len(sets))
    return keys[other], keys[label[other]]


def _compared(docs: DataFrame, dealt: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (root, a, b) among the sets that dealt(fp, root, first, i, j) brings together: a task for each (root, i, j)."""
    # one document for each set, as far as ids tell documents apart
    chosen = small(dealt.select(F.col("first").alias("__chosen")).distinct())
    texts = only(docs, id_col, text_col).join(chosen, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__chosen")), "left_semi")
    sets = _sets(texts, id_col, text_col, False).select("fp", "hashes").join(dealt.drop("first"), "fp")

    def links(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("fp").to_pylist(), table.column("hashes").to_pylist()))
        a, b = set_links(np.array(list(held), np.int64), [np.frombuffer(x, "<u8") for x in held.values()])
        return pa.table({"root": pa.array([table.column("root")[0].as_py()] * len(a), pa.int64()), "a": pa.array(a), "b": pa.array(b)})

    return sets.select("root", "i", "j", "fp", "hashes").groupBy("root", "i", "j").applyInArrow(links, "root long, a long, b long")


def _blocks(block: int) -> Column:
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / NEAR_SHINGLES)).cast("int")


def _block_of(n: str) -> Column:
    return F.pmod(F.xxhash64("fp"), F.greatest(F.col(n), F.lit(1))).cast("int")


def tree_edges(firsts: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between sets of firsts(fp, fingerprint) that join all whose fingerprints the vantage-point tree links."""
    prints = cut(firsts.groupBy("fingerprint").agg(F.min("fp").alias("least")))
    links = close_links(prints.select(F.col("fingerprint").alias("fp")), radius)
    one, other = (prints.select(F.col("fingerprint").alias(x), F.col("least").alias(f"least_{x}")) for x in "ab")
    between = links.join(one, "a").join(other, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return between.unionByName(firsts.join(prints, "fingerprint").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")))


def band_edges(firsts: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of firsts(fp, bands) that join all that share a band."""
    bands = firsts.select("fp", F.explode("bands").alias("band"))
    shared = small(bands.groupBy("band").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("band", "least"))
    return bands.join(shared, "band").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def similar_links(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, block: int = NEAR_BLOCK) -> DataFrame:
    """Links (a, b) between sets (fp) that give the same components as all pairs with Jaccard >= SIMILARITY.

    Candidates are sets whose SimHash fingerprints the vantage-point tree links within MAX_BITS, and, as similarity 0.8
    reaches beyond those bits, sets that share a MinHash band; the pairs of each component of candidates are compared
    exactly. A component of more than `block` documents is dealt into blocks by hash, and has two passes. The first holds every block against
    itself and one of them, which links nearly all of a group of near copies in linear time. Then only pairs can add
    anything that aren't both in the largest part linked so far: the second pass holds all other members against each
    other and against that part, a task for each pair of blocks.
    """
    edges = tree_edges(firsts).unionByName(band_edges(firsts))
    groups = cut(connected_components(edges).withColumnRenamed("node", "fp").join(firsts.select("fp", "first", "size"), "fp"))
    tidy(docs.sparkSession)
    large = small(groups.groupBy("root").agg(_blocks(block).alias("n")).where("n > 1"))
    dealt = groups.join(large, "root", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("k", _block_of("n"))
    meets = F.when(F.col("n") == 1, F.array(F.lit(0))).when(F.col("k") == 0, F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))))
    met = dealt.select("fp", "root", "first", F.lit(0).alias("i"), F.explode(F.coalesce(meets, F.array("k"))).alias("j"))
    found = _compared(docs, small(met), id_col, text_col)
    if large.isEmpty():
        return found.select("a", "b")
    found = cut(found)
    tidy(docs.sparkSession)
    part = connected_components(found.join(large, "root", "left_semi").select("a", "b")).select(F.col("node").alias("fp"), F.col("root").alias("part"))
    members = cut(groups.join(large, "root", "left_semi").join(part, "fp", "left").withColumn("part", F.coalesce("part", "fp")))
    parts = members.groupBy("root", "part").agg(F.count("*").alias("c"))
    main = parts.groupBy("root").agg(F.max(F.struct("c", "part")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    left = members.join(main.select("root", F.col("m.part").alias("main")), "root").withColumn("rest", F.col("part") != F.col("main"))
    sizes = left.groupBy("root", "rest").agg(_blocks(block).alias("n")).groupBy("root")
    sizes = small(sizes.agg(F.max(F.when(F.col("rest"), F.col("n"))).alias("others"), F.max(F.when(~F.col("rest"), F.col("n"))).alias("mains")))
    left = left.join(sizes, "root").withColumn("k", F.when(F.col("rest"), _block_of("others")).otherwise(F.col("others") + _block_of("mains")))
    meets = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("others") + F.col("mains") - 1).otherwise(F.col("others") - 1))
    met = left.select("fp", "root", "first", "k", F.explode(meets).alias("o"))
    met = met.select("fp", "root", "first", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))
    return found.unionByName(_compared(docs, small(met), id_col, text_col)).select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the smallest id; of several rows with that id, one
    with the smallest fingerprint. Rows with a null id come after all others, so one stays where no row of its group
    has an id. Null and empty texts are copies of each other. An empty table gives none."""
    fps = cut(fingerprints(only(docs, id_col, text_col), id_col, text_col))
    firsts = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    found = labelled(fps, firsts, close_links(firsts.select("fp")))
    return _firsts_only(docs, found, id_col, text_col, lambda some: fingerprints(some, id_col, text_col))


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = NEAR_BLOCK) -> DataFrame:
    """As keep_one, by the similarity of texts and not by bits of fingerprints.

    Near-duplicates have sets of 5-word shingles with Jaccard >= 0.8, a text of fewer words being one shingle; groups are
    the components of such pairs. Texts without words are copies of each other. Candidates come from the vantage-point
    tree over SimHash fingerprints and, beyond its radius, from MinHash bands: the radius that 0.8 would need (about 16 of
    64 bits) leaves a vantage-point tree nothing to prune.
    """
    rows = cut(_sets(only(docs, id_col, text_col), id_col, text_col, True))
    same = [F.min("id").alias("first"), F.max("size").alias("size"), F.min("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")]
    firsts = cut(rows.groupBy("fp").agg(*same))
    rows = rows.select("id", "fp")
    tidy(docs.sparkSession)
    links = cut(similar_links(docs, firsts, id_col, text_col, block))
    tidy(docs.sparkSession)
    found = labelled(rows, firsts.select("fp", "first"), links)
    return _firsts_only(docs, found, id_col, text_col, lambda some: _sets(some, id_col, text_col, False).select("id", "fp"))


def _firsts_only(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with one row of each component in found(id, fp, component_id, root); named gives (id, fp) of some rows.

    Nearly all ids are on one row, and rows that aren't the first of their component go by an anti join on the id. Ids on
    several rows, and null ids, don't tell rows apart: those rows get their fingerprints again, one row for each.
    """
    found = cut(found)
    own = F.col(f"`{id_col}`").cast("long")
    first = F.col("component_id").eqNullSafe(F.col("id"))
    per = found.groupBy("id").agg(F.max(first).alias("first"), F.count("*").alias("n"))
    gone = small(per.where("not first or n > 1 or id is null").select(F.col("id").alias("__gone")))
    out = docs.join(gone, own.eqNullSafe(F.col("__gone")), "left_anti")
    crowd = small(per.where("first and (n > 1 or id is null)").select(F.col("id").alias("__id")))
    if crowd.isEmpty():
        return out
    # rows of one id and text are equal here, whatever their other columns hold: the first that Spark meets stays
    some = docs.join(crowd, own.eqNullSafe(F.col("__id")), "left_semi").withColumn("__h", F.xxhash64(own, F.col(f"`{text_col}`").cast("string")))
    texts = some.select(F.col("__h").alias(id_col), F.col(f"`{text_col}`").alias(text_col)).dropDuplicates([id_col])
    held = some.select(own.alias("__id"), "__h").distinct().join(named(texts).select(F.col("id").alias("__h"), "fp"), "__h")
    chosen = found.where(first).groupBy("root").agg(F.min("fp").alias("fp"), F.first("id").alias("__own"))
    picked = held.join(chosen, "fp").where(F.col("__id").eqNullSafe(F.col("__own"))).groupBy("root").agg(F.min("__h").alias("__h"))
    kept = some.join(small(picked.select("__h")), "__h", "left_semi").dropDuplicates(["__h"])
    return out.unionByName(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))
