"""Placement by a permutation-filled lookup table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table; a prime far above the number of shards, so that loads differ little.
SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Fill ``slots`` slots with shard numbers.

    Each shard prefers the slots in an order of its own, a walk of fixed step from a start that its
    name gives; shards take turns to claim the first free slot of their order until none is free. So
    loads differ by one slot at most, and few keys move when a shard comes or goes.
    """
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be prime and shards distinct, at least one and at most slots")
    start = [xxhash.xxh64_intdigest(s, seed=1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    table = np.full(slots, -1, dtype=np.int32)
    at, left = list(start), slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, by its text; a null key counts as the empty text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(spark: SparkSession, rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Return ``key``, ``slot`` and ``shard`` (its number) for every row; other columns are ignored.

    Equal keys share a shard; null keys are placed as the empty text, texts of any length by their
    hash. An empty table gives no rows. Only the table is broadcast: ``slots`` rows of two integers.
    """
    table = lookup_table(shards, slots)
    held = spark.createDataFrame(pa.table({"slot": pa.array(range(slots), pa.int32()), "shard": pa.array(table)}))
    placed = rows.select(F.col(key).alias("key"), slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(held), "slot").select(F.col("key").alias(key), "slot", "shard")
