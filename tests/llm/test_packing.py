import random
from pathlib import Path

import pytest
from helpers import DOCS, corpus, frame

from echosieve.llm import packing as P

pytestmark = pytest.mark.skipif(not Path(P.Packing().ranks).exists(), reason="no vocabulary here")


def brute(lengths, width):
    free, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[i]]
        if fits:
            least = min(free[r] for r in fits)
            r = next(r for r in fits if free[r] == least)
        else:
            rows.append([])
            free.append(width)
            r = len(rows) - 1
        rows[r].append(i)
        free[r] -= lengths[i]
    return sorted(free), len(rows)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_against_brute_force(seed):
    rng = random.Random(seed)
    width = rng.choice([1, 7, 64, 100])
    lengths = [rng.randint(1, width) for _ in range(rng.randint(0, 150))]
    rows = P.best_fit(lengths, width)
    assert sorted(x for r in rows for x in r) == list(range(len(lengths)))
    assert (sorted(width - sum(lengths[x] for x in r) for r in rows), len(rows)) == brute(lengths, width)


def test_round_trip(spark, monkeypatch):
    rows = [*corpus(10), (None, "no id", "", None, 0)]
    rows += [(500, "<|endoftext|> 日本", "", None, 0), (0, rows[0][1], "", None, 0)]
    how = P.Packing(width=64)
    encode = P.encoding(how.ranks).encode_ordinary
    monkeypatch.setattr(P, "SHARD_BYTES", 20_000)
    got = P.packed(frame(spark, rows), how).collect()
    for r in got:
        assert len(r.ids) == 4 * how.width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= how.width
        assert r.resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.pieces) == len(r.resets)
    parts = P.unpacked(got)
    for i, t, *_ in rows:
        whole = [*encode(t or ""), how.end]
        pieces = parts[i]
        assert [x for k in sorted(pieces) for x in pieces[k][0]] == whole
        assert {len(v) for v in pieces.values()} == {2 if i == 0 else 1}
    again = P.packed(frame(spark, rows).repartition(7), how).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert P.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_many_rows_of_one_doc_id_spread(spark, monkeypatch):
    """A row that makes up much of the table is dealt into many shards, each copy once; so are texts without doc_id."""
    monkeypatch.setattr(P, "SHARD_BYTES", 2_000)
    rows = [(7, "the same text " * 5, "", None, 0)] * 300 + [(None, f"text {i}", "", None, 0) for i in range(300)]
    how = P.Packing(width=64)
    got = P.packed(frame(spark, rows), how).collect()
    parts = P.unpacked(got)
    assert [len(v) for v in parts[7].values()] == [300]
    assert len(parts[None][0]) == 300
    shards = {r.shard for r in got if 7 in r.doc_ids}
    assert len(shards) > 5
