"""Groups of linked items: components, stars, leaders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import CELL_D
from ..functions import hashing as H
from .band_join import BANDED, all_pairs, band_pairs
from .tables import stored


def connected(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Label each node of ``pairs(a, b)`` with the least node it is connected to: (node, leader).

    Labels spread along edges and jump to their label's label, so long chains shorten by half a round.
    Each round's labels are written, which cuts the lineage; rounds end when no label changes.
    """
    edges = pairs.where("a <> b").select("a", "b")
    edges = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("leader")).select("node", F.least("node", "leader").alias("leader")))
    for _ in range(most_rounds):
        heard = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("leader").alias("heard"))
        better = labels.join(heard, labels.node == heard.a, "left").select("node", "leader", F.least("leader", "heard").alias("new"))
        better = stored(better)
        up = better.select(F.col("node").alias("at"), F.col("new").alias("jump"))
        following = better.join(up, better.new == up["at"], "left").select("node", F.least("new", "jump").alias("leader"), (F.least("new", "jump") != F.col("leader")).alias("changed"))
        following = stored(following)
        labels = following.select("node", "leader")
        if not following.where("changed").limit(1).count():
            return labels
    raise RuntimeError("labels did not settle")


def _representatives(items: DataFrame) -> DataFrame:
    """The first path of each valid fingerprint: (path, phash). Copies are summed before they are moved."""
    return items.where(H.valid(F.col("phash"))).groupBy("phash").agg(F.min("path").alias("path")).select("path", "phash")


def star_groups(items: DataFrame, most: int = CELL_D) -> DataFrame:
    """Give each item (path, phash) the first item in path order that leads within ``most`` bits.

    An item leads if no earlier leader is that near; membership isn't passed on. Copies of a fingerprint share
    the leader of their first. What is near others is decided within its component, in path order, in a stream
    that holds the leaders of one component. Returns (path, leader) of all items; items without a valid
    fingerprint lead themselves.
    """
    reps = stored(_representatives(items))
    near = stored(band_pairs(reps, most).select("a", "b"))
    parts = connected(near)
    edges = near.join(parts, near.b == parts.node).select(F.col("leader").alias("part"), "a", "b")
    kind = items.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, first, followers = None, None, None, set()
        for batch in batches:
            out = []
            for own, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b")), strict=True):
                if (own, b) != (part, at):
                    if first is not None:
                        out.append((at, first))
                        followers.add(at)
                    if own != part:
                        followers = set()
                    part, at, first = own, b, None
                if first is None and a not in followers:
                    first = a
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], batch.schema.field("a").type) for i in (0, 1)], ["path", "leader"])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], batch.schema.field("a").type) for x in (at, first)], ["path", "leader"])

    led = edges.repartition("part").sortWithinPartitions("part", "b", "a").mapInArrow(run, f"path {kind}, leader {kind}")
    of = reps.join(led, "path", "left").select("phash", F.coalesce("leader", "path").alias("leader"))
    return items.select("path", "phash").join(of, "phash", "left").select("path", F.coalesce("leader", "path").alias("leader"))


def _members(items: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, leader) of valid items: copies and what ``pairs(a, b)`` of representatives connect; the least path leads."""
    joined = connected(pairs.select("a", "b"))
    of = reps.join(joined, reps.path == joined.node, "left").select("phash", F.coalesce("leader", "path").alias("leader"))
    return items.select("path", "phash").join(of, "phash").select("path", "leader")


def duplicate_groups(items: DataFrame, most: int) -> DataFrame:
    """Components of items within ``most`` bits: (leader, path), with the leader's own row; items alone have none.

    Equal fingerprints are one item while pairs are sought, so a picture with very many copies is no more work.
    """
    reps = stored(_representatives(items))
    found = _members(items, reps, band_pairs(reps, most))
    alone = found.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leader")
    return found.join(alone, "leader", "left_semi").select("leader", "path")


def qr_groups(items: DataFrame, most: int) -> DataFrame:
    """Items grouped by fingerprint with the group's size; an item alone is its own group.

    All pairs within ``most`` bits link. Up to 7 bits they share a byte; beyond, all representatives of equal
    fingerprints are compared.
    """
    reps = stored(_representatives(items))
    if most <= BANDED:
        pairs = band_pairs(reps, most)
    else:
        pairs = all_pairs(reps.select(F.col("path").alias("ad"), "phash"), reps.select(F.col("path").alias("target"), "phash"), most).where("ad < target")
        pairs = pairs.select(F.col("ad").alias("a"), F.col("target").alias("b"))
    invalid = items.where(~H.valid(F.col("phash")) | F.col("phash").isNull()).select("path", F.col("path").alias("leader"))
    own = stored(_members(items, reps, pairs).unionByName(invalid).select("leader", "path"))
    return own.join(own.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "leader")


def ranked_members(matches: DataFrame) -> DataFrame:
    """A leader's items by falling similarity, ties in path order."""
    order = Window.partitionBy("leader").orderBy(F.desc("sim"), "item")
    return matches.withColumn("rank", F.row_number().over(order))


def group_keys(matches: DataFrame) -> DataFrame:
    """Sort keys of groups: size with the leader, highest similarity, items that are ad-like."""
    return matches.groupBy("leader").agg(
        (F.count(F.lit(1)) + 1).alias("n"), F.max("sim").alias("best"), F.bool_or(F.coalesce(F.col("tag") == "ad_like", F.lit(False))).alias("ad_like")
    )
