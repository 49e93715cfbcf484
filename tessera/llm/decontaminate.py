"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to e = floor(RATE * m) edits. Cut into e + 1 pieces, one piece at least
must then occur exactly. The pieces of a block of items make an Aho-Corasick automaton, which scans every whole text;
round each hit, Myers's bit-parallel algorithm gives the item's least edit distance to a substring, and the item counts
as found if that is within e. Both sides are lower-cased and white space is folded to single spaces.

An item without an edit budget (below 20 characters) must stand as whole words, and one below LEAST_CHARS characters says
nothing about a document: it is left out, and left_out() lists such items.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, ship, small, written

RATE = 0.05
#: Characters of the shortest normal item that is looked for.
LEAST_CHARS = 8
#: Characters of windows whose results a worker keeps.
SEEN_CHARS = 20_000_000
#: Characters of benchmark items that one pass over the documents takes; more items make more passes.
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return int(rate * len(item))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) for edits + 1 pieces of nearly equal length."""
    bounds = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:]) if b > a]


def myers(item: str, text: str, edits: int) -> tuple[int, int] | None:
    """The least edit distance of item to a substring of text and that substring's end, or None if above edits."""
    m = len(item)
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += ((ph & top) != 0) - ((mh & top) != 0)
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may start anywhere: no carry comes in
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= edits and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def _whole_words(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit stands beside a letter or digit at the ends of text[start:end]."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not before and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items = [(i, t, budget(t, rate)) for i, t in items if t]
        self.seen: dict[tuple[int, str], tuple[int, int] | None] = {}
        self.seen_chars = 0
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item number -> (least distance, end in the normal text)."""
        out: dict[int, tuple[int, int]] = {}
        tried: dict[int, set[int]] = {}
        if not self.items or not text:
            return out
        for end, (n, places) in self.automaton.iter(text):
            for k, offset in places:
                if k in out and out[k][0] == 0:
                    continue
                _, item, edits = self.items[k]
                begin = end + 1 - n - offset
                done = tried.setdefault(k, set())
                if begin in done:
                    continue
                done.add(begin)
                if not edits and not _whole_words(text, begin, begin + len(item)):
                    continue
                low = max(0, begin - edits)
                window = text[low : begin + len(item) + edits]
                if (k, window) not in self.seen:
                    self.seen_chars += len(window) + 100
                    if self.seen_chars > SEEN_CHARS:
                        self.seen.clear()  # a store of results, not of cases: they are computed again
                        self.seen_chars = len(window) + 100
                    at = window.find(item)
                    self.seen[k, window] = (0, at + len(item)) if at >= 0 else myers(item, window, edits)
                got = self.seen[k, window]
                if got and (k not in out or got[0] < out[k][0]):
                    out[k] = (got[0], low + got[1])
        return out


#: The matcher of a Python worker, kept from task to task.
_HELD: dict[str, Matcher] = {}


def _matcher(key: str, held: Broadcast, rate: float) -> Matcher:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Matcher(held.value, rate)
    return _HELD[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id_col, item_col, distance, edit_budget, end_at) for every row of docs and item that occurs in it.

    distance is the least one found round exact pieces, at most edit_budget; end_at counts code points of the normal
    text. Null or empty texts and items match nothing. Repeated rows give rows each; equal items with different ids
    count each. Items of fewer than least_chars normal characters are left out, see left_out(). The benchmark's size is
    measured, and a benchmark above block_chars is taken in blocks, one pass each; then each pass's result is written,
    and its items are let go, before the next one starts.
    """
    items = only(benchmark, item_col, item_text_col).toDF("item", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    ship(docs.sparkSession)
    pair = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id long, item long, distance long, edit_budget long, end_at long"

    def scan(block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text")
        known = [(r.item, normal(r.text)) for r in own.collect()]
        held = docs.sparkSession.sparkContext.broadcast([(i, t) for i, t in known if len(t) >= least_chars])
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, held, rate)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0), batch.column(1)):
                    for k, (distance, end) in sorted(matcher.find(normal(text.as_py())).items()):
                        item, _, edits = matcher.items[k]
                        rows.append((doc.as_py(), item, distance, edits, end))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "item", "distance", "edit_budget", "end_at"])

        out = pair.mapInArrow(run, schema)
        if blocks > 1:
            out = written(out)
            held.destroy()
        return out

    found = reduce(DataFrame.unionByName, [scan(b) for b in range(blocks)])
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "edit_budget", "end_at")


def left_out(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """The items that contaminated() doesn't look for: null, empty, and those of fewer than least_chars characters."""
    folded = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")), r"(?U)\s+", " "))
    return benchmark.where(F.length(folded) < least_chars).select(F.col(f"`{item_col}`"), F.col(f"`{item_text_col}`"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents in which a benchmark item occurs, by id: all rows of an id go together, and rows with
    null ids are one such group. Null and empty texts stay. An empty benchmark keeps all; extra columns stay."""
    bad = small(contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__bad")).distinct())
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col("__bad")), "left_anti")
