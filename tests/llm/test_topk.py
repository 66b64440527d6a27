import math

import numpy as np
from pyspark.sql import functions as F

from echosieve.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, v int"


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in ok:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice([0.0, 0.5, -0.25, 0.1], 8).tolist(), 1, 2, 3) for i in range(100)]
    rows += [(100 + i, [0.5] * 8, 1, 2, 3) for i in range(40)]  # ties
    rows += [(200, None, 1, 1, 1), (205, [None] * 8, 1, 1, 1), (210, [math.inf] * 8, 1, 1, 1), (215, [math.nan] + [0.0] * 7, 1, 1, 1), (220, [0.3] * 3, 1, 1, 1), (225, [], 1, 1, 1), (None, [9.0] * 8, 1, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5)
    assert got(topk.exact_top_k(df, F.col("vec_id") % 5 == 0, 5)) == {q: v for q, v in want.items() if v}


def test_few_rows(spark):
    assert topk.exact_top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0], 0, 0, 0), (1, [1.0], 0, 0, 0)], SCHEMA)
    assert got(topk.exact_top_k(two, F.col("vec_id") % 5 == 0)) == {0: [(1, 65536)]}


def test_rows_that_repeat_a_vec_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i % 12, rng.choice([0.0, 0.5, -0.25], 3).tolist(), 1, 2, 3) for i in range(40)]
    rows += [(0, [0.5, 0.5, 0.5], 1, 2, 3)] * 7 + [(0, [0.5, 0.5], 1, 2, 3), (0, [0.5, 0.5, 0.0], 1, 2, 3)]
    plain = [(i, [math.floor(256 * x) for x in (*v, 0.0, 0.0)[:3]]) for i, v, *_ in rows]
    want = []
    for at, (q, a) in enumerate(plain):
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(plain) if n != at)
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)]
    found = topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, 5)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
