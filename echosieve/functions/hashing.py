"""Fingerprints as 64-bit integers: distances, bands, grids, verdicts. All native expressions but the count of words."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import CELL_D, COARSE_D, HASH_BITS, RESCUED, STRICT_D, whash_bounds

BANDS = 8


def from_hex(text: Column) -> Column:
    """A 64-bit fingerprint from 16 hexadecimal digits; text that isn't one gives null."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("bigint"))


def valid(fingerprint: Column) -> Column:
    """Null and zero fingerprints match nothing."""
    return fingerprint.isNotNull() & (fingerprint != 0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return 1 - distance / F.lit(float(HASH_BITS))


def distance_of(similarity_: Column) -> Column:
    """The nearest distance of a similarity, 0 at least."""
    return F.greatest(F.lit(0), F.bround((1 - similarity_) * HASH_BITS)).cast("int")


def bucket(fingerprint: Column, band: int) -> Column:
    return F.shiftrightunsigned(fingerprint, 8 * band).bitwiseAND(F.lit(255)).cast("int")


def bands(fingerprint: Column) -> Column:
    """The eight (band, bucket) pairs of a fingerprint."""
    return F.array(*(F.struct(F.lit(b).alias("band"), bucket(fingerprint, b).alias("bucket")) for b in range(BANDS)))


def first_common_band(a: Column, b: Column) -> Column:
    """The lowest band in which two fingerprints agree; null if none."""
    x = a.bitwiseXOR(b)
    return F.coalesce(*(F.when(bucket(x, i) == 0, F.lit(i)) for i in range(BANDS)))


def cells_alike(a: Column, b: Column) -> Column:
    """Grid cells that are valid on both sides and within the cell distance."""
    alike = F.zip_with(a, b, lambda x, y: F.when((x != 0) & (y != 0) & (hamming(x, y) <= CELL_D), 1).otherwise(0))
    return F.aggregate(alike, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def whash_bound(d_p: Column) -> Column:
    """The largest wavelet-hash distance that accepts at a coarse distance."""
    return F.element_at(F.array(*map(F.lit, whash_bounds())), (F.least(d_p, F.lit(COARSE_D)) + 1).cast("int"))


def passes_whash(d_p: Column, d_w: Column) -> Column:
    """``d_w`` is null where either wavelet hash is invalid."""
    return F.coalesce(d_w <= whash_bound(d_p), F.lit(False))


def accepted(d_p: Column, d_w: Column, rescue: Column) -> Column:
    return rescue | passes_whash(d_p, d_w) | (d_w.isNotNull() & (d_p <= STRICT_D))


def final_similarity(d_p: Column, d_w: Column, rescue: Column) -> Column:
    by_both = F.when(passes_whash(d_p, d_w), similarity(F.least(d_p, d_w))).otherwise(similarity(d_p))
    return F.when(rescue, F.greatest(similarity(d_p), F.lit(RESCUED))).otherwise(by_both)


def word_hash(word: Column, start: int = 1) -> Column:
    """64 bits of a word's MD5, from its ``start``-th hexadecimal digit."""
    return F.conv(F.substring(F.md5(word), start, 16), 16, -10).cast("bigint")


#: Words whose bits a task keeps, their bytes, and words that are counted at once.
KEPT_WORDS, KEPT_BYTES, COUNTED = 1 << 16, 1 << 24, 1 << 14


def _counts(texts: Iterable[bytes], starts: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Per text the number of its words and, for each of ``starts``, how many of them have each of 64 bits set."""
    known, size, table = {}, 0, np.empty((0, 64 * len(starts)), dtype=np.float32)
    for text in texts:
        words, found = text.split(b" "), np.zeros(64 * len(starts), dtype=np.int64)
        for at in range(0, len(words), COUNTED):
            part = Counter(words[at : at + COUNTED])
            if len(known) > KEPT_WORDS or size > KEPT_BYTES:
                known, size, table = {}, 0, table[:0]
            new = [w for w in part if w not in known]
            if new:
                hexed = [hashlib.md5(w, usedforsecurity=False).hexdigest() for w in new]
                own = np.array([[int(h[k - 1 : k + 15], 16) for k in starts] for h in hexed], dtype="<u8")
                if len(known) + len(new) > len(table):
                    table = np.concatenate([table, np.empty((max(1024, len(table), len(new)), table.shape[1]), dtype=np.float32)])
                table[len(known) : len(known) + len(new)] = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                size += sum(map(len, new))
            rows = np.fromiter(map(known.__getitem__, part), dtype=np.int64, count=len(part))
            # Counts of so few words are exact in 32-bit floats.
            found += (np.fromiter(part.values(), dtype=np.float32, count=len(part)) @ table[rows]).astype(np.int64)
        yield len(words), found


def simhash(docs: DataFrame, key: str, text: str, **starts: int) -> DataFrame:
    """Word SimHashes of 64 bits: a column for each of ``starts`` (which MD5 digits its bits come from).

    Words are counted in their row, and a task makes a word's hash once while it remembers it, so texts and words
    aren't shuffled. Each sum counts two bits, 32 places apart; rows that repeat ``key`` are one.
    """
    digits, names = tuple(starts.values()), [f"{c}_{i}" for c in starts for i in range(32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, bits = zip(*_counts(batch.column("t").to_pylist(), digits), strict=True)
            bits = np.stack(bits).reshape(len(n), len(digits), 2, 32)
            sums = (bits[:, :, 0] + (bits[:, :, 1] << 32)).reshape(len(n), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in sums.T)], [key, "n", *names])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.lower(F.col(text)).cast("binary").alias("t")).where("t is not null")
    counted = rows.mapInArrow(run, ", ".join([f"`{key}` {kind}", "n long", *(f"{c} long" for c in names)]))
    voted = counted.groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
    low, high = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)), lambda x: F.shiftrightunsigned(x, 32)
    one = lambda v, i: F.when(2 * v > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))

    def bits(c: str) -> Column:
        # Higher-order functions keep the expression small, however often the planner repeats it.
        own = F.array(*(f"{c}_{i}" for i in range(32)))
        each = F.transform(own, lambda v, i: one(low(v), i).bitwiseOR(one(high(v), i + 32)))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))

    return voted.select(key, *(bits(c).alias(c) for c in starts))
