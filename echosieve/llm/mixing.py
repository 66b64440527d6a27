"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .text import COPIES, copied


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources by code point, null last, and repeat.

    A block has ``block`` tokens; a source takes at most ``repeats`` times its size. A shard holds
    about ``shard_rows`` documents of one source, the unit that one task orders. Per source and per
    shard the driver holds one row of numbers.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    repeats: int = 3
    block: int = 16
    shard_rows: int = 4096
    seed: int = 20


#: Above so many sources their table is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], how: Mix) -> list[float]:
    """Share the sum of sizes by weight; what is above the cap is shared anew among the others."""
    out = [0.0] * len(sizes)
    weight = [how.weights[i % len(how.weights)] for i in range(len(sizes))]
    free, left = [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while free:
        share = left / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * share > how.repeats * sizes[i]]
        for i in full or free:
            out[i] = float(how.repeats * sizes[i]) if full else weight[i] * share
        if not full:
            break
        left -= sum(out[i] for i in full)
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def apportion(weights: np.ndarray, caps: np.ndarray, blocks: int) -> np.ndarray:
    """Give each of ``blocks`` blocks to the highest quotient ``weight / (2*have + 1)`` under its cap.

    Ties go to the first. The bulk is found by bisection on the quotient that is reached, the rest
    block by block.
    """
    weights, caps = np.asarray(weights, dtype=np.float64), np.asarray(caps, dtype=np.int64)
    caps = np.where(weights > 0, caps, 0)
    blocks = int(min(blocks, caps.sum()))
    have = np.zeros(len(weights), dtype=np.int64)
    if not blocks:
        return have

    def above(level: float) -> np.ndarray:
        """Blocks whose quotient is over the level: weight / (2*j + 1) > level for j below that number."""
        with np.errstate(over="ignore", divide="ignore"):
            reach = np.ceil((weights / level - 1) / 2)
        return np.minimum(np.clip(reach, 0, 2.0**62).astype(np.int64), caps)

    low, high = 0.0, float(weights.max()) * 2
    for _ in range(200):
        level = (low + high) / 2
        if level in (low, high):
            break
        if above(level).sum() > blocks:
            low = level
        else:
            high = level
    have = above(high)
    left = blocks - int(have.sum())
    queue = [(-weights[i] / (2 * have[i] + 1), i) for i in np.flatnonzero(have < caps)]
    heapq.heapify(queue)
    while left > 0 and queue:
        _, i = heapq.heappop(queue)
        have[i] += 1
        left -= 1
        if have[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * have[i] + 1), i))
    return have


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:  # noqa: B008
    """Decide how many words of each document a mix of its sources takes.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; other columns are ignored. Returns a row per
    row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``. A null source is a
    source of its own; null and empty texts have size 0 and take 0; rows that repeat are documents
    each, of which any may be taken first, and are counted before they are moved; if there are no words,
    all targets are 0. No rows: none.

    Blocks go to sources in proportion to their targets, then to each source's shards in proportion
    to their sizes. A shard is read in an order that ``seed`` and doc_id give, over and over, until
    its blocks are full, so the first documents are taken once more than the last and one in part.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    sized = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    sized = written(sized.withColumn("turn", F.xxhash64(F.lit(how.seed), "doc_id", "size")), "sized")
    words = F.col("size") * F.col("times")
    found = sized.groupBy("source").agg(F.sum(words).alias("n"), F.sum("times").alias("rows"), F.max("times").alias("most")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in found]
    wanted = targets(sizes, how)
    sources = spark.createDataFrame(pa.table({
        "name": pa.array([r.source for r in found], pa.string()), "ix": pa.array(range(len(found)), pa.int32()),
        "source_size": pa.array(sizes, pa.int64()), "target": pa.array(wanted, pa.float64()),
        "shards": pa.array([-(-r.rows // how.shard_rows) for r in found], pa.int64()),
    }))
    sources = F.broadcast(sources) if len(found) <= BROADCAST_SOURCES else sources
    rows = sized.join(sources, sized.source.eqNullSafe(sources.name))
    rows = rows.withColumn("shard", F.pmod("turn", "shards").cast("int"))

    parts = rows.groupBy("ix", "shard").agg(F.sum(words).alias("n")).toPandas().sort_values(["ix", "shard"], ignore_index=True)
    block = how.block
    per_source = apportion(np.array(wanted), -(-how.repeats * np.array(sizes, dtype=np.int64) // block), round(sum(sizes) / block))
    parts["quota"] = np.zeros(len(parts), dtype=np.int64)
    for ix, own in parts.groupby("ix"):
        n = own["n"].to_numpy()
        got = apportion(n, -(-how.repeats * n // block), int(per_source[ix]))
        parts.loc[own.index, "quota"] = np.minimum(got * block, how.repeats * n)
    columns = {c: pa.array(parts[c], t) for c, t in (("ix", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("quota", pa.int64()))}
    quotas = spark.createDataFrame(pa.table(columns))

    order = Window.partitionBy("ix", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(quotas, ["ix", "shard"]).withColumn("start", F.sum(words).over(order) - words)
    rows = copied(rows, F.col("times"), "copy", max((r.most for r in found), default=0) > COPIES)
    whole, rest = F.expr("quota div greatest(n, 1L)"), F.expr("quota % greatest(n, 1L)")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("copy") * F.col("size")))
    taken = F.when(F.col("n") > 0, whole * F.col("size") + part).otherwise(0).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, how: Mix = Mix()) -> DataFrame:  # noqa: B008
    """Return the rows of ``docs`` that a mix takes, each as often as it is taken, with all columns.

    A document's words are taken whole: what :func:`mix` takes of it is rounded to the nearest number of
    copies, halves up. Documents without words are kept once. Rows that repeat a doc_id are counted
    together and come in the nearest equal number.
    """
    found = mix(docs, how)
    times = found.groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("n"))
    copies = F.when(F.col("n") > 0, F.floor(F.col("t") / F.col("n") + 0.5)).otherwise(1).cast("int")
    times = written(times.select(F.col("doc_id").alias("_mix_id"), copies.alias("_mix_n")).where("_mix_n > 0"), "copies")
    joined = docs.join(times, docs.doc_id.cast("long").eqNullSafe(times["_mix_id"]))
    again = F.explode(F.sequence(F.lit(1), times["_mix_n"])).alias("_mix_copy")
    return joined.select(*[docs[c] for c in docs.columns], again).drop("_mix_copy")
