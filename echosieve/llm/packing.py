"""Token ids packed into rows of fixed width by best-fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import COPIES, collapsed, copied

#: Fixed value: the pattern by which byte-level vocabularies of this family cut a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a shard, which one task packs, and tokens that it packs together at most.
SHARD_BYTES, WINDOW_TOKENS = 8 << 20, 1 << 22
#: Partitions at most; beyond, a task packs several shards one after the other, with the same rows.
MOST_TASKS = 100_000


@dataclass(frozen=True)
class Packing:
    """``ranks``: a vocabulary file of base64 tokens and ranks, which the driver reads and broadcasts.

    Each text ends with the token ``end``; rows have ``width`` ids, filled up with ``pad``.
    """

    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    width: int = 2048
    end: int = 50256
    pad: int = 50256


#: Bytes of a vocabulary file that a broadcast may hold.
MOST_VOCABULARY = 64 << 20


@lru_cache(maxsize=4)
def _encoding(lines: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str) -> bytes:
    """A vocabulary file's lines, of a size that a broadcast may hold."""
    data = Path(path).read_bytes()
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"{path} has over {MOST_VOCABULARY} bytes")
    return data


def encoding(path: str) -> tiktoken.Encoding:
    """The encoding that a vocabulary file defines."""
    return _encoding(vocabulary(path))


class _Capacities:
    """Open rows by free places, in a segment tree that finds the least capacity that suffices."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._count(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row of the least capacity that is at least ``least``, with that capacity."""
        at = least + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._count(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Put items of at most ``width`` into rows, the longest first, each where least stays free."""
    free, rows = _Capacities(width), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[item])
        row, capacity = found or (len(rows), width)
        if found is None:
            rows.append([])
        rows[row].append(item)
        if capacity > lengths[item]:
            free.put(row, capacity - lengths[item])
    return rows


_SCHEMA = "shard int, row long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>"
_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
        ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ]
)


def packed(docs: DataFrame, how: Packing = Packing()) -> DataFrame:  # noqa: B008
    """Tokenise all whole texts of ``docs`` and pack them into rows of ``how.width`` ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row per packed row:
    ``shard`` and ``row`` in it, ``n_tokens``, ``ids`` (little-endian 32-bit integers, ``width`` of them;
    those past ``n_tokens`` are padding), ``cu_seqlens`` (0 and where each segment ends), ``resets`` (where
    positions start from 0 again: each segment's start), and the ``doc_ids`` and ``pieces`` of the segments.
    Joined in order of pieces, a document's segments are its tokens and one end. Null and empty texts are
    one end; rows that repeat are documents each, whose pieces repeat; a null doc_id is kept as null. A
    text over the width becomes pieces of the width and a shorter last one. No documents, no rows.

    Texts are dealt into shards by doc_id, text and number of the copy; a task streams its shard's texts in order and packs them by
    windows of ``WINDOW_TOKENS``, so memory is bounded and a second attempt gives the same rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    once, most = collapsed(rows)
    rows = copied(once, F.col("times"), "copy", most > COPIES).drop("times")
    shard = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), "copy"), F.lit(shards)).cast("int")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(how.ranks))

    def window(shard: int, first: int, items: list[tuple[int | None, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = best_fit([len(x[2]) for x in items], how.width)
        for at in range(0, len(rows), 512):
            out = []
            for i, row in enumerate(rows[at : at + 512], first + at):
                ends = np.cumsum([0, *(len(items[x][2]) for x in row)], dtype=np.int32)
                ids = np.full(how.width, how.pad, dtype="<i4")
                ids[: ends[-1]] = np.concatenate([items[x][2] for x in row])
                out.append((shard, i, int(ends[-1]), ids.tobytes(), ends.tolist(), ends[:-1].tolist(), [items[x][0] for x in row], [items[x][1] for x in row]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        now, count, held, items = None, 0, 0, []
        for b in batches:
            for mine, doc_id, text in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if items and (mine != now or held >= WINDOW_TOKENS):
                    for out in window(now, count, items):
                        count += out.num_rows
                        yield out
                    items, held = [], 0
                if mine != now:
                    now, count = mine, 0
                ids = encode(text.as_py())
                ids.append(how.end)
                ids = np.array(ids, dtype=np.int32)
                held += len(ids)
                items += [(doc_id, i // how.width, ids[i : i + how.width]) for i in range(0, len(ids), how.width)]
        if items:
            yield from window(now, count, items)

    dealt = rows.withColumn("shard", shard).repartition(min(int(shards), MOST_TASKS), "shard")
    return dealt.sortWithinPartitions("shard", "doc_id", F.char_length("text"), F.xxhash64("text")).mapInArrow(run, _SCHEMA)


def unpacked(rows: list) -> dict:
    """The tokens of each (doc_id, occurrence) of packed rows that the caller holds; ends included."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<i4")
        for doc_id, piece, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(doc_id, {}).setdefault(piece, []).append(ids[a:b].tolist())
    return parts
