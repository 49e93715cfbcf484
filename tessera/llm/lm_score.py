"""Stupid-backoff scores: every document under the n-gram counts of all other documents.

The count table is partitioned by the n-grams' 64-bit hash; the exploded n-grams of the documents are joined to it and
summed by document. Documents are dealt into chunks of bounded size by hash, and a chunk's n-grams are counted in the
chunk first, so a very common n-gram is one entry for each chunk, however often it occurs. The entries (hash, count) go
to the partitions (buckets) of the table, are summed there over all chunks, and the join gives each chunk the counts
that the other chunks have. Entries travel as columnar blocks, one for each chunk and bucket: sorted hashes as
differences, with their bytes transposed, which zstd then brings to about 5.5 bytes. A block holds (entries of a chunk) *
(entries of a bucket) / (all entries); so it gets smaller as the input grows, and a row by itself is the limit.

Score of word w at a place whose longest history has n - 1 words: (c(h w) - own) / (c(h) - own) for the longest history
h that was seen with w in another document, times ALPHA for each word by which h was shortened; own is the count in the
document itself. Without a history, c(w) / (all words - own); a word that no other document has counts as 1.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, ship

ORDER = 3
ALPHA = 0.4
#: Characters of a chunk, and chunks for each bucket of the count table: both bound what a task holds.
CHUNK_CHARS, PER_BUCKET = 8_000_000, 2
SEED = 42
#: The key under which a chunk's number of words is counted.
ALL = np.uint64(0)


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams from the key of the history and the last word's (the finalizer of SplitMix64)."""
    z = history * np.uint64(0x9E3779B97F4A7C15) + (word ^ np.uint64(0xD1B54A32D192ED03))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Chunk:
    """The n-grams of some texts, of which text k stands for weights[k] equal rows."""

    def __init__(self, texts: list[bytes], weights: list[int], order: int):
        known: dict[bytes, int] = {}
        ids, lengths = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = text.lower().split()
            lengths[k] = len(words)
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in known), np.uint64, len(known))
        word = hashes[np.concatenate(ids)] if known else np.empty(0, np.uint64)
        del ids, known
        self.order, self.lengths, self.weights = order, lengths, np.array(weights, np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        self.place = np.arange(len(word), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        self.words = int((lengths * self.weights).sum())
        # the places that end an n-gram of each order, and all their keys in order
        self.ends = [np.flatnonzero(self.place >= k) for k in range(order)]
        keys, longer = [word], word
        for k in range(1, order):
            longer = np.concatenate([np.zeros(min(1, len(word)), np.uint64), _mixed(longer[:-1], word[1:])])
            keys.append(longer[self.ends[k]])
        self.all = np.concatenate(keys)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the keys, the starts of the distinct ones in it, and the number of each occurrence's key."""
        order = np.argsort(self.all)
        ranked = self.all[order]
        new = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        del ranked
        return order, np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1

    def _owner(self) -> np.ndarray:
        return np.concatenate([self.doc[e] for e in self.ends])

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys with counts, ALL first."""
        order, starts, _ = self._sorted()
        if not len(order):
            return np.full(1, ALL), np.zeros(1, np.int64)
        counts = np.add.reduceat(self.weights[self._owner()[order]], starts)
        return np.concatenate([[ALL], self.all[order[starts]]]), np.concatenate([[self.words], counts])

    def scores(self, others: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of log10 scores, and the words scored with a shortened history; others holds, for the
        keys of table(), the counts in other chunks."""
        n = len(self.doc)
        if not n:
            return np.zeros(len(self.lengths)), np.zeros(len(self.lengths), np.int64)
        order, starts, number = self._sorted()
        owner = self._owner()[order]
        inside = np.add.reduceat(self.weights[owner], starts)
        # what other rows have: all but a single row's own count, which is 1 unless the key comes twice in the chunk
        seen_sorted = np.add(others[1:], inside - 1)[number]
        del inside
        times = np.diff(np.append(starts, len(number)))
        twice = np.flatnonzero((times > 1)[number])
        pair = number[twice].astype(np.int64) * len(self.lengths) + owner[twice]
        del number, owner, times
        at = np.argsort(pair)
        pair = pair[at]
        new = np.ones(len(at), bool)
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        count = np.diff(np.append(np.flatnonzero(new), len(at)))
        seen_sorted[twice[at]] -= np.repeat(count - 1, count)
        del pair, at, new, twice
        flat = np.empty(len(order), np.int64)
        flat[order] = seen_sorted
        del order, seen_sorted
        seen, at = [], 0
        for e in self.ends:
            full = np.zeros(n, np.int64)
            full[e] = flat[at : at + len(e)]
            seen.append(full)
            at += len(e)
        rest = np.maximum(others[0] + self.words - self.lengths, 1)[self.doc]
        del flat
        score, used = np.log10(np.maximum(seen[0], 1) / rest), np.zeros(n, np.int8)
        for k in range(1, self.order):
            history = np.zeros(n, np.int64)
            history[1:] = seen[k - 1][:-1]
            hit = seen[k] > 0
            score = np.where(hit, np.log10(np.maximum(seen[k], 1) / np.maximum(history, 1)), score)
            used = np.where(hit, k, used)
        short = np.minimum(self.place, self.order - 1) - used
        score += short * math.log10(alpha)
        by = lambda x: np.bincount(self.doc, weights=x, minlength=len(self.lengths))
        return by(score), by(short > 0).astype(np.int64)


def _small(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _whole(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b""


def _out(x: np.ndarray) -> bytes:
    return _small(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _in(raw: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(_whole(raw, 8 * n), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([keys[:1], np.diff(keys)])


def _dealt(rows: Iterator[tuple[int | None, bytes]], chunks: int) -> dict[int, dict[tuple[int | None, bytes], int]]:
    """Rows by chunk; equal rows become one, with their number."""
    out: dict[int, dict[tuple[int | None, bytes], int]] = defaultdict(lambda: defaultdict(int))
    for doc, text in rows:
        out[xxhash.xxh64_intdigest(text, (doc or 0) % 2**64) % chunks][doc, text] += 1
    return out


def _merged(group: pa.Table) -> tuple[list[int | None], list[bytes], list[int]]:
    """Ids, texts and weights of a chunk, in an order that depends on the rows alone."""
    held: dict[tuple[int | None, bytes], int] = defaultdict(int)
    for ids, weights, sizes, raw in zip(*(group.column(c).to_pylist() for c in ("ids", "weights", "sizes", "texts"))):
        joined, at = _whole(raw, sum(sizes)), 0
        for doc, weight, size in zip(ids, weights, sizes):
            held[doc, joined[at : at + size]] += weight
            at += size
    rows = sorted(held.items(), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][1]))
    return [d for (d, _), _ in rows], [t for (_, t), _ in rows], [w for _, w in rows]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id_col, n_words, n_backoff, log10_score, log10_per_word) for every row of docs.

    Words are ASCII-lower-cased runs of anything but ASCII white space. A null or empty text has no words and the
    scores 0. Repeated rows are documents of their own, and so see each other; rows that repeat both id and text travel
    as one with their number. A null id stays null. An empty table gives none.
    """
    total = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_chars))
    shift = 64 - max(1, math.ceil(math.log2(chunks / PER_BUCKET)) if chunks > PER_BUCKET else 1)
    ship(docs.sparkSession)
    own = only(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist())
            rows = []
            for chunk, held in _dealt(zip(batch.column(0).to_pylist(), texts), chunks).items():
                joined = b"".join(t for _, t in held)
                rows.append((chunk, [d for d, _ in held], list(held.values()), [len(t) for _, t in held], _small(joined)))
            if rows:
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["chunk", "ids", "weights", "sizes", "texts"])

    dealt = own.mapInArrow(deal, "chunk long, ids array<long>, weights array<int>, sizes array<int>, texts binary")

    def count(group: pa.Table) -> pa.Table:
        _, texts, weights = _merged(group)
        keys, counts = Chunk(texts, weights, order).table()
        found, start = np.unique((keys >> np.uint64(shift)).astype(np.int64), return_index=True)
        ends = [*start[1:], len(keys)]
        return pa.table({
            "bucket": pa.array(found), "chunk": pa.array([group.column("chunk")[0].as_py()] * len(found), pa.int64()),
            "n": pa.array([b - a for a, b in zip(start, ends)], pa.int64()),
            "keys": pa.array([_out(_gaps(keys[a:b])) for a, b in zip(start, ends)], pa.binary()),
            "counts": pa.array([_out(counts[a:b]) for a, b in zip(start, ends)], pa.binary()),
        })

    counted = dealt.groupBy("chunk").applyInArrow(count, "bucket long, chunk long, n long, keys binary, counts binary")

    def add_up(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_in(x, n, np.uint64), dtype=np.uint64) for x, n in zip(group.column("keys").to_pylist(), sizes)])
        counts = np.concatenate([_in(x, n, np.int64) for x, n in zip(group.column("counts").to_pylist(), sizes)])
        at = np.argsort(keys)
        ranked = keys[at]
        new = np.ones(len(at), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        sums = np.add.reduceat(counts[at], np.flatnonzero(new))
        others = np.empty(len(at), np.int64)
        others[at] = sums[np.cumsum(new) - 1]
        others -= counts
        parts = np.split(others, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "n": group.column("n"), "others": pa.array([_out(p) for p in parts], pa.binary())})

    summed = counted.groupBy("bucket").applyInArrow(add_up, "chunk long, bucket long, n long, others binary")

    def join(group: pa.Table, table: pa.Table) -> pa.Table:
        ids, texts, weights = _merged(group)
        chunk = Chunk(texts, weights, order)
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "others"))))
        logs, short = chunk.scores(np.concatenate([_in(raw, n, np.int64) for _, n, raw in parts]), alpha)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip((ids, weights, chunk.lengths, short, logs), kinds)], names=["id", "rows", "n", "short", "logs"])

    scored = dealt.groupBy("chunk").cogroup(summed.groupBy("chunk")).applyInArrow(join, "id long, rows int, n long, short long, logs double")
    per = F.when(F.col("n") > 0, F.col("logs") / F.col("n")).otherwise(F.lit(0.0))
    each = scored.select("*", F.explode(F.array_repeat(F.lit(0), F.col("rows"))))
    return each.select(
        F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("short").alias("n_backoff"),
        F.round("logs", 5).alias("log10_score"), F.round(per, 7).alias("log10_per_word"),
    )


def _sql_order(k: int) -> str:
    """The tables of k-grams, all of them (g) and by document (o)."""
    by = ", ".join(f"w{j}" for j in range(k))
    some = "" if k == 1 else f" where w{k - 1} is not null"
    return f"g{k} as (select {by}, count(*) as c from places{some} group by all), o{k} as (select doc_id, {by}, count(*) as c from places{some} group by all)"


def _sql_seen(k: int, name: str, first: int = 0) -> str:
    """Joins that give, as name, the count in other documents of the k words that end `first` words before the place."""
    on = lambda t: " and ".join(f"p.w{j + first} = {t}.w{j}" for j in range(k))
    return f" left join g{k} {name}g on {on(name + 'g')} left join o{k} {name}o on p.doc_id = {name}o.doc_id and {on(name + 'o')}"


#: For order 3. w0 is the word of a place, w1 and w2 the words before it.
ORACLE_SQL = f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
words as (select doc_id, unnest(ws) as w0, generate_subscripts(ws, 1) as i from w),
places as (select *, lag(w0) over (partition by doc_id order by i) as w1, lag(w0, 2) over (partition by doc_id order by i) as w2 from words),
{_sql_order(1)}, {_sql_order(2)}, {_sql_order(3)},
n as (select count(*) as c from places), n_own as (select doc_id, count(*) as c from places group by doc_id),
seen as (select p.doc_id, least(p.i - 1, 2) as most, ag.c - ao.c as c1, coalesce(bg.c - bo.c, 0) as c2, coalesce(cg.c - co.c, 0) as c3,
   coalesce(hg.c - ho.c, 0) as h1, coalesce(kg.c - ko.c, 0) as h2, greatest(n.c - no.c, 1) as rest
  from places p{_sql_seen(1, "a")}{_sql_seen(2, "b")}{_sql_seen(3, "c")}{_sql_seen(1, "h", 1)}{_sql_seen(2, "k", 1)}
  cross join n join n_own no on p.doc_id = no.doc_id),
scored as (select doc_id, most, case when c3 > 0 then 2 when c2 > 0 then 1 else 0 end as used,
  case when c3 > 0 then log10(c3 / h2) when c2 > 0 then log10(c2 / h1) else log10(greatest(c1, 1) / rest) end as s from seen),
summed as (select doc_id, count(*) as n, count(*) filter (where used < most) as nb, sum(s + (most - used) * log10({ALPHA})) as s from scored group by doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(nb, 0) as bigint) as n_backoff,
  round(coalesce(s, 0), 5) as log10_score, round(coalesce(s / n, 0), 7) as log10_per_word
from documents d left join summed s on d.doc_id = s.doc_id"""
