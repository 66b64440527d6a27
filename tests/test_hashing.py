"""Fingerprint expressions and the settings they follow from."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from echosieve.conf import Settings, most_distance, whash_bounds
from echosieve.functions import hashing as H
from echosieve.operators import band_join as B


def test_thresholds_are_distances():
    assert [most_distance(x) for x in (0.40, 0.70, 0.93, 0.95, 0.98)] == [38, 19, 4, 3, 1]


def test_whash_table():
    assert whash_bounds() == [19] * 5 + [18, 17, 17, 16, 15, 14, 13, 12, 11, 10, 10, 9, 8, 7, 6]


def test_gate_tolerances_at_95():
    g = Settings().gate
    assert (round(g.hue, 4), round(g.saturation, 4), round(g.value, 4), round(g.achroma, 4)) == (20.8333, 0.2167, 0.1333, 0.15)


def test_hex_and_hamming(spark):
    rows = [("0000000000000000", 0), ("ffffffffffffffff", -1), ("8000000000000000", -(2**63)), ("1234567890123456", 0x1234567890123456), ("xyz", None), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", H.from_hex(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == dict(rows)
    d = spark.range(1).select(H.hamming(F.lit(-1), F.lit(0)).alias("a"), H.hamming(F.lit(5), F.lit(5)).alias("b"), H.hamming(F.lit(-(2**63)), F.lit(0)).alias("c")).first()
    assert tuple(d) == (64, 0, 1)


@pytest.mark.parametrize("most", [0, 1, 3, 7, 19])
def test_band_pairs_against_brute_force(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) - 2**63 for _ in range(20)]
    hashes = [b ^ sum(1 << (i if i < 63 else 62) for i in rng.sample(range(63), rng.randint(0, 9))) for b in base for _ in range(6)] + [0, None]
    items = list(enumerate(hashes))
    got = {(r.a, r.b, r.d) for r in B.band_pairs(spark.createDataFrame(items, "path long, phash long"), most).collect()}
    want = set()
    for i, x in items:
        for j, y in items:
            if i < j and x and y:
                z = (x ^ y) & (2**64 - 1)
                if z.bit_count() <= most and any(not (z >> 8 * b) & 255 for b in range(8)):
                    want.add((i, j, z.bit_count()))
    assert got == want and len(B.band_pairs(spark.createDataFrame(items, "path long, phash long"), most).collect()) == len(got)


def test_rescue_needs_twelve_cells(spark):
    g = [1 << 40 | i for i in range(1, 17)]
    other = g[:11] + [~x for x in g[11:]]
    rows = [("eleven", 0xFFFFF, 0, g, other), ("twelve", 0xFFFFF, 0, g, [*other[:11], g[11] ^ 7, *other[12:]]), ("near", 0xFF, 0, g, g), ("far", 2**39 - 1, 0, g, g), ("zero", 0xFFFFF, 0, [0] * 16, [0] * 16)]
    df = spark.createDataFrame(rows, "k string, phash_a long, phash_b long, grid_a array<long>, grid_b array<long>")
    assert {r.k for r in B.grid_rescues(df).where("rescue").collect()} == {"twelve"}


def test_verdict(spark):
    rows = [(d, w) for d in range(20) for w in [None, *range(0, 25)]]
    df = spark.createDataFrame(rows, "d int, w int").select("d", "w", H.accepted(F.col("d"), F.col("w"), F.lit(False)).alias("ok"), H.final_similarity(F.col("d"), F.col("w"), F.lit(False)).alias("s"))
    table = whash_bounds()
    for r in df.collect():
        passes = r.w is not None and r.w <= table[r.d]
        assert r.ok == (passes or (r.w is not None and r.d <= 4))
        assert r.s == 1 - (min(r.d, r.w) if passes else r.d) / 64


def test_simhash_moves_no_words(spark, monkeypatch):
    """Votes by definition, whatever a task remembers; rows of a key are one; the shuffle has a row a key."""
    texts = {1: "a b b  c", 2: "", 3: "x " * 40_000, 4: "Ä é A"}
    rows = [*texts.items(), (1, "c c d"), (5, None)]
    docs = spark.createDataFrame(rows, "k long, t string").coalesce(1)

    def vote(words, at):
        own = [int(hashlib.md5(w.encode()).hexdigest()[at : at + 16], 16) for w in words]
        u = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in own) > len(own))
        return u - (1 << 64) if u >> 63 else u

    words = {k: v.lower().split(" ") for k, v in texts.items()}
    words[1] += ["c", "c", "d"]
    for kept in (1 << 16, 0):
        monkeypatch.setattr(H, "KEPT_WORDS", kept)
        got = H.simhash(docs, "k", "t", p=1, w=17)
        assert {r.k: (r.p, r.w) for r in got.collect()} == {k: (vote(v, 0), vote(v, 16)) for k, v in words.items()}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("Exchange hashpartitioning") <= 2
