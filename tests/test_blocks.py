"""Pairs judged block against block, against all pairs one by one; the queries of round 3 use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echosieve.conf import Settings, whash_bounds
from echosieve.operators import blocks, funnel
from echosieve.queries import modes, similarity

BOUNDS = whash_bounds()


def _rows(seed, n=90, name=lambda i: f"p{i}"):
    """Fingerprints in few families, invalid ones, missing colours and folders, grey and odd hues."""
    rng = np.random.default_rng(seed)
    flip = lambda h, k: int(h) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False))
    base = rng.integers(1, 2**62, 5)
    rows = []
    for i in range(n):
        p, w = flip(base[i % 5], int(rng.integers(0, 16))), flip(base[i % 3], int(rng.integers(0, 14)))
        hsv = None if i % 17 == 0 else (float(rng.integers(0, 361)), float(rng.choice([0.0, 0.1, 0.17, 0.18, 0.5, 0.9])), float(rng.random()))
        rows.append((name(i), None if i % 11 == 3 else f"f{i % 3}", [0, None, p][min(2, i % 19)], [0, None, w][min(2, i % 13)], hsv))
    return rows


def _frame(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"path {kind}, folder_path string, phash long, whash long, hsv struct<h double, s double, v double>")


def _near(x, y):
    z = (x ^ y) & (2**64 - 1)
    return z.bit_count() if z.bit_count() <= 19 and any(z >> 8 * i & 255 == 0 for i in range(8)) else None


def _colour(a, b, d, g):
    (h1, s1, v1), (h2, s2, v2) = a or (0, 0, 0), b or (0, 0, 0)
    if d <= 4:
        return True
    if max(s1, s2) < g.low_saturation:
        return abs(v1 - v2) <= g.value and abs(v1 * (1 - s1) - v2 * (1 - s2)) <= g.achroma and abs(s1 - s2) <= g.low_saturation_step
    return min(abs(h1 - h2), 360 - abs(h1 - h2)) <= g.hue and abs(s1 - s2) <= g.saturation


def _verdict(x, y, d):
    d_w = (x ^ y).bit_count() if x and y else None
    passes = d_w is not None and d_w <= BOUNDS[d]
    return d_w, 1 - (min(d, d_w) if passes else d) / 64 if passes or d_w is not None and d <= 4 else None


def _all(rows):
    rows = sorted((r for r in rows if r[2]), key=lambda r: r[0])
    return [(x, y, d) for i, x in enumerate(rows) for y in rows[i + 1 :] if (d := _near(x[2], y[2])) is not None]


@pytest.mark.parametrize("kind", ["string", "bigint"])
@pytest.mark.parametrize("size", [1 << 15, 64])
def test_pairs_of_blocks_against_all_pairs(spark, monkeypatch, kind, size):
    monkeypatch.setattr(blocks, "CHUNK", size)
    rows, settings = _rows(7, name=(lambda i: f"p{i}") if kind == "string" else lambda i: i * 7 % 90), Settings(similarity_threshold=80.0)
    df, every = _frame(spark, rows, kind), _all(rows)
    assert len(every) > 300
    got = lambda **x: sorted(tuple(r) for r in funnel.judged_pairs(df, settings, **x).collect())
    assert got() == sorted((x[0], y[0], d) for x, y, d in every)
    assert got(apart=True) == sorted((x[0], y[0], d) for x, y, d in every if x[1] != y[1])
    assert got(colored=True) == sorted((x[0], y[0], d) for x, y, d in every if _colour(x[4], y[4], d, settings.gate))
    judged = [(x[0], y[0], d, *_verdict(x[3], y[3], d)) for x, y, d in every]
    assert got(least=0.8) == sorted(r for r in judged if r[4] is not None and r[4] >= 0.8)


@pytest.mark.parametrize(("folders", "colours", "waves"), [(True, True, True), (False, True, True), (True, False, False)])
def test_counts_of_blocks(spark, folders, colours, waves):
    rows = _rows(3)
    settings = Settings(similarity_threshold=80.0, inter_folder_only=folders, use_color_filter=colours, use_whash=waves)
    every = _all(rows)
    apart = [p for p in every if not folders or p[0][1] != p[1][1]]
    passed = [p for p in apart if not colours or _colour(p[0][4], p[1][4], p[2], settings.gate)]
    entered = sum(1 for x, y, _ in passed if waves and x[3] and y[3])
    sims = [_verdict(x[3], y[3], d)[1] if waves else 1 - d / 64 for x, y, d in passed]
    want = (len(every), len(apart), len(passed), entered, len(every) - len(apart), sum(1 for s in sims if s is not None and s >= 0.8))
    assert tuple(funnel.counters(_frame(spark, rows), settings).first()) == want
    assert tuple(funnel.counters(_frame(spark, rows).limit(0), settings).first()) == (0,) * 6


def test_one_shared_fingerprint_is_no_hot_task(spark):
    """All items share all bytes: a join by bytes puts every pair of a bucket into one task."""
    df = spark.range(600).select("id", F.col("id").alias("path"), F.lit(77).cast("long").alias("phash"))
    got = blocks.pairs(df, blocks.Rule()).withColumn("task", F.spark_partition_id())
    assert got.count() == 600 * 599 // 2 and got.select("task").distinct().count() > 1


@pytest.mark.parametrize("name", ["color_gate_filter", "funnel_stats"])
def test_queries_meet_no_pair_by_shared_bytes(spark, name):
    """A join by bytes meets every pair of a bucket one by one, before the distance is known."""
    plan = similarity.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "bucket" not in plan


def test_turned_ads_meet_items_in_blocks(spark):
    """The best member of each leader, by the nearest turn, of equal similarities the first; not through a join by bytes."""
    ads = [(i, r[2], r[3], r[4], {90: (r[2] or 0) << 1 & (2**62 - 1), 180: 0}) for i, r in enumerate(_rows(11, 40))]
    items = _rows(11, 80, lambda i: 20 + i)
    known = spark.createDataFrame(ads, "path long, phash long, whash long, hsv struct<h double, s double, v double>, phash_rot map<int,bigint>")
    settings = Settings(similarity_threshold=75.0)
    frame = _frame(spark, items, "bigint")
    found = funnel.ad_matches(known, known.select("path", (F.col("path") % 4).alias("leader")), frame, settings)
    want = {}
    for a, h, w, c, turns in ads:
        for b, _, k, v, e in items:
            if not h or not k or a == b or not any((h ^ k) >> 8 * i & 255 == 0 for i in range(8)):
                continue
            d = min((h ^ k).bit_count(), ((turns[90] or h) ^ k).bit_count())
            if d <= 19 and _colour(c, e, d, settings.gate):
                d_w, sim = _verdict(w, v, d)
                if sim is not None and sim >= 0.75:
                    want[a % 4, b] = min(want.get((a % 4, b), (0, 99)), (-sim, a, d, d_w))
    got = {(r.leader, r.item): (-r.sim, r.member, r.d_p, r.d_w) for r in found.collect()}
    assert got == want and len(want) > 10
    assert "bucket" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" not in modes.mode_ad(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
