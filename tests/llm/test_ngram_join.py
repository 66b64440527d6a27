import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, corpus, frame
from pyspark.sql import functions as F

from echosieve.llm import ngram_join as J
from echosieve.llm.components import components
from echosieve.llm.storage import written
from echosieve.llm.text import shingle_sets


def sets_of(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, how):
    sets = sets_of(rows, how.words)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and how.den * len(sets[a] & sets[b]) >= how.num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("how", "seed"), [(J.Jaccard(3, 9, 10), 1), (J.Jaccard(5, 4, 5), 2), (J.Jaccard(3, 1, 2), 3), (J.Jaccard(1, 7, 10), 4)])
def test_against_brute_force(spark, how, seed):
    rows = corpus(seed)
    assert got(J.ngram_components(frame(spark, rows), how)) == brute(rows, how)


def test_small_tiles_are_cut_into_blocks(spark):
    rows = corpus(5)
    how = J.Jaccard(3, 4, 5, tile_shingles=40, tile_rows=3)
    assert got(J.ngram_components(frame(spark, rows), how)) == brute(rows, how)


def test_empty_table_and_null_ids(spark):
    assert J.ngram_components(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "x"), (4, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in J.ngram_components(df).collect()), key=str) == sorted([(None, 3), (3, 3), (None, None), (4, 4)], key=str)


def test_keep_one_keeps_columns_and_clean_rows(spark):
    rows = corpus(6)
    how = J.Jaccard(5, 4, 5)
    df = frame(spark, rows)
    kept = J.keep_one(df, how)
    assert kept.columns == df.columns
    want = {i for i, (_, c) in brute(rows, how).items() if c == i}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    twice = df.union(df.where("doc_id = 0"))
    assert sorted(r.doc_id for r in J.keep_one(twice, how).collect()) == sorted(want)


def test_linked_sets_share_a_range():
    rng = random.Random(1)
    for how in (J.Jaccard(3, 9, 10), J.Jaccard(5, 4, 5)):
        for _ in range(400):
            n = rng.choice([1, 2, 3, 5, 9, 10, 19, 50, 333])
            base = [rng.getrandbits(64) for _ in range(n)]
            other = list(base)
            for _ in range(rng.randint(0, n // 5 + 1)):
                if rng.random() < 0.5 and len(other) > 1:
                    other.pop(rng.randrange(len(other)))
                else:
                    other.append(rng.getrandbits(64))
            a, b = (np.array(sorted(set(x)), dtype=np.uint64) for x in (base, other))
            both = len(np.intersect1d(a, b))
            if how.den * both >= how.num * (len(a) + len(b) - both):
                for cut in (0, 1, 2):
                    assert set(J.range_digests(a, how, cut).tolist()) & set(J.range_digests(b, how, cut).tolist())


def test_a_line_that_very_many_texts_share_makes_no_candidates():
    rng = np.random.default_rng(3)
    line = np.array([1 << 63], dtype=np.uint64)
    for how in (J.Jaccard(3, 9, 10), J.Jaccard(5, 4, 5)):
        sets = [np.unique(np.append(rng.integers(0, 2**64, n, dtype=np.uint64), line)) for n in rng.integers(40, 900, 400)]
        keys = np.concatenate([np.unique(J.range_digests(s, how)) for s in sets])
        assert len(np.unique(keys)) == len(keys)


def test_large_clusters_are_told_apart_by_other_cuts(spark):
    """Texts that share half of their words with all others, and some near copies among them."""
    rng, how = random.Random(4), J.Jaccard(5, 4, 5, tile_rows=5)
    passage = " ".join(f"p{i}" for i in range(24))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(24))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(0, 20, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    copies = J.set_features(docs, how).select(F.col("doc_id").alias("rep"), "n_shingles", "d1")
    near = written(components(J._stars(J._tile_keys(docs, how))).select("node", F.col("label").alias("cluster")), "near")
    largest = lambda x: x.groupBy("cluster").count().agg(F.max("count")).first()[0]
    before = largest(near)
    assert largest(J._narrowed(docs, copies, near, how)) < before
    assert got(J.ngram_components(docs, how)) == brute(rows, how)


def test_bitmaps_never_rule_out_a_link():
    rng = random.Random(2)
    sets = [np.array(sorted({rng.getrandbits(64) for _ in range(rng.choice([3, 300, 600]))}), dtype=np.uint64) for _ in range(20)]
    near = [np.sort(np.append(s[1:], np.uint64(rng.getrandbits(64)))) for s in sets if len(s) > 100]
    links = J.linked(sets + near, J.Jaccard(3, 9, 10))
    assert len(links) == len(near)


def test_shingles_of_sliced_columns():
    column = pa.array(["zz zz", "A b c", None, "", "a B C d"]).slice(1)
    assert [len(s) for s in shingle_sets(column, 3)] == [1, 0, 0, 2]
    a, _, _, d = shingle_sets(column, 3)
    assert a[0] in d


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(51), 0) | {100: 100, 101: 100}


def test_keep_one_tells_rows_that_repeat_a_doc_id_apart(spark):
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "quite another clean text here now"), (7, "quite another clean text here now"), (7, ""), (9, "x y z u v w"), (None, "a b c d e f")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted({rows[0], rows[2], rows[4], rows[5], rows[6]}, key=str)
