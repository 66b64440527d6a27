"""Vectorised tokenising and hashing of whole Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text that are hashed at once; a longer text is hashed by itself, whole.
BLOCK = 1 << 18

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max(n - 1, BLOCK).bit_length()
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=_U)
        if size <= 4 * BLOCK:
            _POWERS[name] = have
    return have


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts and ends in them (a null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, at


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hash the words of a text column, block by block.

    A-Z are lower-cased and words are runs of anything but ASCII white space. Yields the row a block
    starts with, the 64-bit hashes of its words in order, and, per row of the block, where its words
    start in those (with the end of the last).
    """
    data, at = _spans(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + BLOCK, side="right")) - 1
        last = min(n, max(first + 1, last))
        part = _LOWER[data[at[first] : at[last]]]
        gap = _IS_SPACE[part]
        # A text's first byte starts a word even where the text before it ends without white space.
        edge = at[first : last + 1] - at[first]
        word = ~gap
        head = word.copy()
        head[1:] &= gap[:-1]
        inner = edge[:-1][edge[:-1] < len(part)]
        head[inner] |= word[inner]
        tail = word.copy()
        tail[:-1] &= gap[1:]
        ends = edge[1:][edge[1:] > 0] - 1
        tail[ends] |= word[ends]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        run = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum((part.astype(_U) + _U(1)) * _powers("up", _BASE, len(part) + 1)[: len(part)], out=run[1:])
        hashes = (run[end] - run[start]) * _powers("down", _BASE_INVERSE, len(part) + 1)[start]
        yield first, mix(hashes + (end - start).astype(_U)), np.searchsorted(start, edge)
        first = last


def _joined(words: np.ndarray, k: int) -> np.ndarray:
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = mix(out * _BASE + words[j : len(words) - k + 1 + j])
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row, its distinct k-word shingles as sorted 64-bit hashes.

    Fewer than k words make one shingle, the whole sequence; no words make none.
    """
    for _, words, at in word_hashes(column):
        grams = _joined(words, k) if len(words) >= k else words[:0]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= k:
                own = np.sort(grams[lo : hi - k + 1])
                keep = np.empty(len(own), dtype=bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif hi > lo:
                yield mix(_joined(words[lo:hi], hi - lo) + _U(hi - lo))
            else:
                yield words[:0]


#: Copies of a row that one task makes at once; more are spread.
COPIES = 1 << 16


#: A row that occurs more often, or whose occurrences have more bytes of text, is read once and counted.
OFTEN, MUCH = 256, 1 << 20


def collapsed(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``rows(doc_id, text, ...)``, those that repeat doc_id and text very often once, with ``times``; and the most times.

    Repeats are found by the text's hash and summed in each task before any is moved, so a row that makes up
    much of a table costs no task more than others. Rows that occur a few times stay as they are.
    """
    marked = rows.withColumn("_mark", F.xxhash64("text"))
    many = (F.col("times") > OFTEN) | ((F.col("times") > 1) & (F.col("times") * F.col("size") > MUCH))
    again = marked.groupBy("doc_id", "_mark").agg(F.count(F.lit(1)).alias("times"), F.max(F.octet_length("text")).alias("size"))
    again = written(again.where(many), "repeats")
    most = again.agg(F.max("times")).first()[0] or 1
    once = F.lit(1).cast("long").alias("times")
    if most == 1:
        return rows.select("*", once), 1
    keys = again.select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_same"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_same"))
    single = marked.join(keys, same, "left_anti").select(*rows.columns, once)
    rest = [F.first(c).alias(c) for c in rows.columns if c not in ("doc_id", "text")]
    repeated = marked.join(keys, same, "left_semi").groupBy("doc_id", "_mark").agg(F.first("text").alias("text"), *rest, F.count(F.lit(1)).alias("times"))
    return single.unionByName(repeated.select(*single.columns)), most


def copied(rows: DataFrame, times: Column, number: str, many: bool) -> DataFrame:
    """Undo :func:`collapsed`: each row as often as ``times`` says, numbered from 0 in ``number``.

    With ``many``, copies are made by many tasks.
    """
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(times, F.lit(1)) - 1, F.lit(COPIES).cast("long"))).alias("_first")
    chunks = rows.select("*", times.alias("_times"), first)
    if many:
        chunks = chunks.repartition("_first", "doc_id")
    last = F.least(F.col("_first") + COPIES, F.col("_times")) - 1
    return chunks.select(*(F.col(c) for c in rows.columns), F.explode(F.sequence("_first", last)).alias(number))
