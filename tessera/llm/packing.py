"""Cost-balanced packing of tokenised documents into sequences, without a shuffle.

A task reads its documents in order and packs them in groups of about GROUP tokens, which bounds memory. Pieces of full
length are sequences of their own. What remains of the documents goes, longest first, to the sequence of lowest
estimated cost that has room left; the cost of a piece is linear plus quadratic (attention) in its length. A piece that
doesn't fit is cut, and the rest queues again by its length. The sequences of a group have 2048 tokens each, and the
tokens left over at its end make sequences whose lengths are powers of two: so none is padded.

The task's partition number makes sequence ids unique, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship

LENGTH = 2_048
GROUP = 4_194_304
EOS = 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: A text with a longer word or run of white space than this goes to the tokenizers library, whose merging is not quadratic in its length.
LONG_WORD = 2_000
LONG_SPACE = re.compile(r"\s{1000}")
# Fixed value: the pattern that splits text for byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids for the vocabulary file. Its merges rank as its ids do, so tiktoken gives the ids
    that tokenizers gives, several times as fast; texts with very long words, or with the content of an added token, which
    is one id there, go through tokenizers itself."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:  # a file of the Python environment, not of the data
        read = json.load(f)
    special = {t["content"] for t in read["added_tokens"]}
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return whole.encode(text, add_special_tokens=False).ids
        if len(text) > LONG_WORD and (max(map(len, text.split()), default=0) > LONG_WORD or LONG_SPACE.search(text)):
            return whole.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Full sequences, then powers of two for the rest, largest first."""
    full, rest = divmod(total, length)
    return [length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) for items of sizes below `length`; sequences count from 0."""
    rooms = capacities(sum(sizes), length)
    used = [0] * len(rooms)
    open_ = [(0.0, k) for k in range(len(rooms))]
    queue = [(-n, k, 0) for k, n in enumerate(sizes) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, item, start = heapq.heappop(queue)
        spent, seq = open_[0]
        piece = min(-n, rooms[seq] - used[seq])
        out.append((item, start, piece, seq, used[seq]))
        used[seq] += piece
        if used[seq] < rooms[seq]:
            heapq.heapreplace(open_, (spent + cost(piece), seq))
        else:
            heapq.heappop(open_)
        if piece < -n:
            heapq.heappush(queue, (n + piece, item, start + piece))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: SCHEMA, and with with_ids the piece's ids as array<int>.

    A null or empty text gives the end token alone. Rows with null ids are packed too, with a null doc_id. Repeated
    rows are packed each. An empty table gives none. The texts' other columns aren't read.
    """
    path = tokenizer or default_tokenizer()

    def packed(held: list[tuple[int | None, np.ndarray]], first: int) -> tuple[list[tuple], int]:
        rows, rest, seq = [], [], first
        for k, (_, ids) in enumerate(held):
            for start in range(0, len(ids) - length + 1, length):
                rows.append((k, start, length, seq, 0))
                seq += 1
            rest.append(len(ids) % length)
        for k, start, n, s, offset in assign(rest, length):
            rows.append((k, len(held[k][1]) - rest[k] + start, n, seq + s, offset))
        seq += len(capacities(sum(rest), length))
        rows.sort(key=lambda r: (r[3], r[4]))
        return rows, seq

    def batch_of(held: list, rows: list[tuple], base: int) -> pa.RecordBatch:
        item, start, n, seq, offset = (list(x) for x in zip(*rows))
        cut = [held[k][1][s : s + m] for k, s, m in zip(item, start, n)]
        columns = [[held[k][0] for k in item], start, n, [zlib.crc32(c) for c in cut], [len(held[k][1]) for k in item], [base + s for s in seq], offset]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            arrays.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base, seq, held, tokens = TaskContext.get().partitionId() << 40, 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), EOS], dtype="<u4")
                held.append((doc.as_py(), ids))
                tokens += len(ids)
                if tokens >= group:
                    rows, seq = packed(held, seq)
                    yield batch_of(held, rows, base)
                    held, tokens = [], 0
        if held:
            rows, seq = packed(held, seq)
            yield batch_of(held, rows, base)

    ship(docs.sparkSession)
    pair = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return pair.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
