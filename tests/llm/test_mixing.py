import numpy as np
import pytest
from helpers import DOCS, corpus, frame

from echosieve.llm import mixing as M


def brute(weights, caps, blocks):
    have = [0] * len(weights)
    for _ in range(blocks):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and have[i] < caps[i]]
        if not open_:
            break
        i = max(open_, key=lambda j: (weights[j] / (2 * have[j] + 1), -j))
        have[i] += 1
    return have


@pytest.mark.parametrize("seed", range(30))
def test_apportionment_against_quotients(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 12))
    weights, caps = rng.choice([0, 1, 2, 3, 5.5, 100], n).astype(float), rng.integers(0, 60, n)
    blocks = int(rng.integers(0, 200))
    assert M.apportion(weights, caps, blocks).tolist() == brute(weights.tolist(), caps.tolist(), blocks)


def test_targets():
    how = M.Mix()
    assert M.targets([100, 100, 100], how) == [300 * 5 / 8, 300 * 2 / 8, 300 / 8]
    got = M.targets([1, 1000, 1000, 0], how)
    assert got[0] == 3 and got[3] == 0 and sum(got) == pytest.approx(2001) and got[1] == 2 * got[2]
    assert M.targets([], how) == [] and M.targets([0, 0], how) == [0, 0]


def test_mix(spark):
    rows = corpus(8)
    docs = frame(spark, [*rows, rows[0]])
    for how in (M.Mix(), M.Mix(shard_rows=7, seed=3)):
        got = M.mix(docs, how).collect()
        assert len(got) == len(rows) + 1
        sizes = {i: len((t or "").split()) for i, t, *_ in rows}
        assert all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in got)
        by = {}
        for r in got:
            by.setdefault(r.source, []).append(r)
        order = sorted(by, key=lambda s: (s is None, s or ""))
        want = M.targets([sum(r["size"] for r in by[s]) for s in order], how)
        for s, t in zip(order, want, strict=True):
            assert {r.target for r in by[s]} == {t} and {r.source_size for r in by[s]} == {sum(r["size"] for r in by[s])}
            assert abs(sum(r.taken for r in by[s]) - t) <= how.block * (2 + len(by[s]) // how.shard_rows)
        assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(5), how).collect()))


def test_mixed_rows(spark):
    rows = corpus(9)
    docs = frame(spark, rows)
    out = M.mixed(docs)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in M.mix(docs).collect():
        if r["size"]:
            assert abs(times.get(r.doc_id, 0) * r["size"] - r.taken) <= r["size"] / 2
        else:
            assert times[r.doc_id] == 1


def test_empty_and_wordless(spark):
    assert M.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = M.mix(spark.createDataFrame([(1, "", "", None, 0), (None, None, "", "a", 0)], DOCS)).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]


def test_a_row_that_repeats_very_often(spark, monkeypatch):
    from echosieve.llm import text

    rows = [(7, "a b c", "en", "x", 0)] * 500 + [(i, "d e f g", "en", "x", 0) for i in range(100, 200)] + [(None, "h i", "en", "y", 0)] * 300
    want = sorted(map(str, M.mix(frame(spark, rows)).collect()))
    monkeypatch.setattr(text, "COPIES", 16)
    monkeypatch.setattr(M, "COPIES", 16)
    got = M.mix(frame(spark, rows)).collect()
    assert sorted(map(str, got)) == want and len(got) == len(rows)
    for source in "xy":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 32 and all(r.taken <= 3 * r["size"] for r in own)
