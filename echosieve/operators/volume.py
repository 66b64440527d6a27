"""Volumes that are the same: by series name, by shared pages, by ordered matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from .groups import connected
from .tables import stored


def sample_pages(pages: DataFrame, ad_hashes: DataFrame, last: int | None) -> DataFrame:
    """The last ``last`` pages of each folder (by ``ord``; None: all) whose fingerprint no ad has, ranked from the end."""
    kept = pages.where(H.valid(F.col("phash"))).join(ad_hashes.select("phash").distinct(), "phash", "left_anti")
    order = Window.partitionBy("folder").orderBy(F.desc("ord"))
    ranked = kept.withColumn("rank", F.row_number().over(order))
    return ranked if last is None else ranked.where(F.col("rank") <= last)


#: Folders of one name that a row holds, and pairs that a task makes.
BLOCK, PAIRS_A_TASK = 256, 1 << 22


def intra_pairs(folders: DataFrame) -> DataFrame:
    """Pairs of folders ``a < b`` with an equal series name.

    Folders of a name are held in blocks, and each pair of blocks is a row until the task that returns its pairs.
    Few bytes become very many pairs, so tasks are dealt by the number of pairs, and a large name is many rows.
    """
    named = stored(folders.select("path", "skeleton").where("path is not null and skeleton is not null"))
    sizes = named.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0
    dealt = named.join(sizes, "skeleton").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")))
    held = dealt.repartition("skeleton", "block").groupBy("skeleton", "block").agg(F.max("blocks").alias("blocks"), F.sort_array(F.collect_list("path")).alias("paths"))
    keys, tasks = ["skeleton", "lo", "hi"], int(pairs // PAIRS_A_TASK) + 1
    first, last = F.explode(F.sequence(F.lit(0).cast("long"), "block")), F.explode(F.sequence("block", F.col("blocks") - 1))
    x = held.select("skeleton", F.col("block").alias("lo"), last.alias("hi"), F.col("paths").alias("xs")).repartition(tasks, *keys)
    y = held.select("skeleton", first.alias("lo"), F.col("block").alias("hi"), F.col("paths").alias("ys")).repartition(tasks, *keys)
    each = x.join(y, keys).select("skeleton", "lo", "hi", "ys", F.posexplode("xs").alias("i", "x"))
    others = F.when(F.col("lo") == F.col("hi"), F.slice("ys", F.col("i") + 2, F.size("ys"))).otherwise(F.col("ys"))
    both = each.select("skeleton", "x", F.explode(others).alias("y")).where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "skeleton")


def cross_pairs(pages: DataFrame, folders: DataFrame) -> DataFrame:
    """Pairs of folders of different names that share the first 56 bits of some sampled page."""
    of = pages.select("folder", F.shiftright("phash", 8).alias("prefix")).distinct().join(folders.select(F.col("path").alias("folder"), "skeleton"), "folder")
    x, y = of.alias("x"), of.alias("y")
    joined = x.join(y, (F.col("x.prefix") == F.col("y.prefix")) & (F.col("x.folder") < F.col("y.folder")) & (F.col("x.skeleton") != F.col("y.skeleton")))
    return joined.select(F.col("x.folder").alias("a"), F.col("y.folder").alias("b")).distinct()


def first_fit(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Match each of ``a`` in order with the first free one of ``b`` within ``most`` bits."""
    free, matched = np.ones(len(b), dtype=bool), 0
    for h in a:
        near = np.flatnonzero(free & (np.bitwise_count(b ^ h) <= most))
        if len(near):
            free[near[0]] = False
            matched += 1
    return matched


def matched_pages(pairs: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """Count the ordered first-fit matches of each pair of folders: (a, b, matched, ratio).

    A folder's pages are a bounded array (a sample of its last pages), so each pair is one row and the
    matching, which depends on order, runs on batches of rows.
    """
    arrays = pages.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phash"))), lambda x: x["phash"]).alias("h"))
    joined = pairs.join(arrays.select(F.col("folder").alias("a"), F.col("h").alias("ha")), "a").join(arrays.select(F.col("folder").alias("b"), F.col("h").alias("hb")), "b")

    def run(batches):
        for batch in batches:
            out = [first_fit(np.array(x, dtype=np.int64), np.array(y, dtype=np.int64), most) for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n"), pa.array(out, pa.int32())], ["a", "b", "n", "matched"])

    kind = pairs.schema["a"].dataType.simpleString()
    rows = joined.select("a", "b", F.least(F.size("ha"), F.size("hb")).alias("n"), "ha", "hb")
    found = rows.mapInArrow(run, f"a {kind}, b {kind}, n int, matched int")
    return found.select("a", "b", "matched", (F.col("matched") * 100.0 / F.col("n")).alias("ratio"))


def series(folders: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Name series that duplicate volumes join: (skeleton, series), the shortest and then first name."""
    of = folders.select("path", "skeleton")
    named = duplicates.join(of.select(F.col("path").alias("a"), F.col("skeleton").alias("sa")), "a").join(of.select(F.col("path").alias("b"), F.col("skeleton").alias("sb")), "b")
    joined = connected(named.select(F.col("sa").alias("a"), F.col("sb").alias("b")))
    names = of.select("skeleton").distinct().join(joined, F.col("skeleton") == F.col("node"), "left").select("skeleton", F.coalesce("leader", "skeleton").alias("leader"))
    best = names.groupBy("leader").agg(F.min(F.struct(F.length("skeleton"), "skeleton")).alias("m"))
    return names.join(best, "leader").select("skeleton", F.col("m.skeleton").alias("series"))


def series_rows(folders: DataFrame, names: DataFrame) -> DataFrame:
    """Folders of series that have at least two: (series, path, volumes)."""
    joined = folders.join(names, "skeleton").withColumn("volumes", F.count(F.lit(1)).over(Window.partitionBy("series")))
    return joined.where("volumes >= 2").select("series", "path", "volumes")
