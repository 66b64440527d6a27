"""Exact top-k inner products by term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Rows of a query block and of a candidate block; their score arrays bound a task's memory.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192


def scaled(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component as long; null where the vector can take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, short rows filled up with zeros."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    among = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def block_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int) -> list[tuple]:
    """The k best of one block of candidates for each query row: (query, position, score).

    Rows are distinct and stand for ``times`` equal ones; a query is one of the rows itself, which then
    stands for one less.
    """
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, rows))
    postings = []
    for t in range(width):
        at = np.flatnonzero(rows[:, t])
        postings.append((slice(None) if len(at) == len(rows) else at, rows[at, t].copy()))
    found = []
    for q, own in enumerate(query_ids):
        scores = np.zeros(len(rows), dtype=np.int64)
        for t in np.flatnonzero(queries[q]):
            at, weights = postings[t]
            scores[at] += weights * queries[q, t]
        left = times.copy()
        same = np.flatnonzero(ids == own)
        left[same[(rows[same] == queries[q]).all(axis=1)]] -= 1
        other = np.flatnonzero(left > 0)
        best = other[_best(scores[other], ids[other], k)]
        for p in np.repeat(best, np.minimum(left[best], k))[:k]:
            found.append((q, p, scores[p]))
    return found


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """For each query row, the k rows of highest integer inner product.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored. Candidates are all rows but
    the query's own. Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the smaller
    vec_id, and a query with fewer candidates gets all of them. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part; a shorter vector counts as filled up with
    zeros. Rows that repeat a vec_id are queries and candidates each, with equal vectors or other ones. No
    queries or an empty table give no rows. Scores are exact as 64-bit integers.

    Equal rows are counted and searched once. Each block of queries meets each block of candidates in one
    task, which scatters the weighted postings of a query's terms into a dense score array and selects by
    partition; a window over k rows a block merges.
    """
    scaled_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), is_query.alias("q"))
    # Zeros at a vector's end change neither a score nor which rows are equal.
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("v"), F.lit(1))), F.lit(0), lambda at, i: F.when(F.try_element_at("v", i) != 0, i).otherwise(at))
    rows = scaled_rows.where("v is not null and vec_id is not null").withColumn("v", F.slice("v", F.lit(1), end))
    rows = written(rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"), F.max("q").alias("q")), "vectors")
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    n_cb, n_qb = -(-n_rows // CANDIDATE_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    # Rows of a vec_id are told apart by two hashes of their vectors.
    own = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    left = rows.where("q").select("vec_id", "v", "times", own.alias("own"), block(n_qb).alias("qb"), number(n_cb).alias("cb")).select("vec_id", "v", "times", "own.a", "own.b", "qb", "cb")
    right = rows.select("vec_id", "v", "times", block(n_cb).alias("cb"), number(n_qb).alias("qb"))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        own = q.column("vec_id").to_numpy() if q.num_rows else np.zeros(0, np.int64)
        ids = c.column("vec_id").to_numpy() if c.num_rows else np.zeros(0, np.int64)
        if len(own) and len(ids):
            found = block_top(_matrix(q.column("v")), own, _matrix(c.column("v")), ids, c.column("times").to_numpy(), k)
        at = np.array([x[0] for x in found], dtype=np.int64)
        query = {n: pa.array(q.column(of).to_numpy()[at] if q.num_rows else [], pa.int64()) for n, of in (("query_id", "vec_id"), ("a", "a"), ("b", "b"), ("times", "times"))}
        return pa.table(query | {"vec_id": pa.array([ids[x[1]] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.int64())})

    schema = "query_id long, a long, b long, times long, vec_id long, score long"
    tops = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id", "a", "b").orderBy(F.desc("score"), "vec_id")
    ranked = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")
    return ranked.select("query_id", "rank", "vec_id", "score", copy).drop("copy")
