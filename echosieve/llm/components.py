"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written


def _lowest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``, written so that a join on ``u`` may split hot keys."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _lowest(both)
    joined = both.join(lowest, "u").withColumn("m", F.least("u", "m"))
    out = written(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    dropped(lowest)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = _lowest(edges)
    joined = edges.join(lowest, "u")
    down = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(down.union(joined.select("u", F.col("m").alias("v"))).distinct(), "edges")
    dropped(lowest)
    return out


def _mark(edges: DataFrame) -> tuple:
    half: Column = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(half)).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(u long, v long)`` with the least node it is joined to.

    Self loops and repeated edges are allowed and nulls ignored. Returns ``(node, label)`` for each
    node of an edge between two different nodes; no edges, no rows. Every round is two shuffles of
    at most the remaining edges, and the edges turn into stars in a logarithmic number of rounds.
    """
    now = edges.where("u <> v").select(
        F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
    )
    now = written(now.distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds if mark[0] else 0):
        large = _large_star(now)
        dropped(now)
        now = _small_star(large)
        dropped(large)
        if mark == (mark := _mark(now)):
            break
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.distinct())
