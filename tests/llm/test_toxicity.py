import math
import re
import time

import numpy as np
import pytest
from helpers import DOCS, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from echosieve.llm import toxicity as T


@pytest.fixture
def lexicon():
    return T.Lexicon({" idiot ": 5.0, " moron ": 5.0, " clown ": 4.0, " réeux": 4.0}, curve=(-3.0, 1.0, 1.0))


@pytest.mark.parametrize("word", ["idiot", "IDIOT", "1d10t", "іdіоt", "i.d.i.o.t", "idi0t!!!", "ｉｄｉｏｔ", "id​iot"])
def test_folding_finds_disguises(lexicon, word):
    assert lexicon.weights(T.fold(f"you {word}, go")) == [5.0]


def test_clean_words_and_exceptions(lexicon):
    assert lexicon.weights(T.fold("idiotic 1024 clown fish, clownish")) == []
    assert lexicon.weights(T.fold("a clown fish and a clown")) == [4.0]
    assert lexicon.weights(T.fold("réeuxment")) == [4.0]


def test_length_normalises(lexicon):
    dense, thin = T.inputs(lexicon, "idiot here"), T.inputs(lexicon, "idiot " + "word " * 500)
    assert dense[1] == thin[1] and dense[2] > thin[2]


def test_terms_are_closed_and_significant(spark):
    counts = [(" idi", 40, 0, 40, 0), (" idio", 40, 0, 40, 0), (" idiot", 40, 0, 40, 0), (" idiot ", 39, 0, 39, 0), (" the ", 500, 4000, 50, 400), (" rar", 3, 0, 3, 0)]
    found = T._telling(spark.createDataFrame(counts, "term string, t long, o long, dt long, do long"), (5000, 40000), (50, 400))
    assert list(T.chosen_terms(map(tuple, found.collect()))) == [" idiot "]


def test_no_bound_on_terms(spark):
    """More telling terms than any fixed number are all kept."""
    counts = [(f" term{i} ", 40, 0, 40, 0) for i in range(6000)]
    found = T._telling(spark.createDataFrame(counts, "term string, t long, o long, dt long, do long"), (500_000, 4_000_000), (50, 400))
    assert len(T.chosen_terms(map(tuple, found.collect()))) == 6000


def brute_inputs(lexicon, text):
    """What the curve weighs, word by word and phrase by phrase, without an automaton."""
    folded = T.fold(text)
    words, at, weights = folded.split(), 1, []
    spared = [(m.start(), m.start() + len(T.fold(p)) - 1) for p in lexicon.exceptions for m in re.finditer(f"(?={re.escape(T.fold(p))})", folded)]
    for word in words:
        hits = [t for t in lexicon.terms if f" {word} ".startswith(t)]
        if hits and not any(a <= at - 1 < b for a, b in spared):
            weights.append(lexicon.terms[max(hits, key=len)])
        at += len(word) + 1
    total, n = sum(weights), max(1, len(words))
    return [1.0, math.log1p(total), math.log1p(100 * total / n)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["clown", "fish", "clownish", "idiot", "idiots", "1diot", "réeuxment", "proof", "a", "II", "trash", "can", "trash can", "pond scum"]), max_size=30))
def test_scores_against_brute_force(words):
    lexicon = T.Lexicon({" idiot ": 5.0, " idio": 2.0, " clown ": 4.0, " réeux": 4.5, " trash ": 3.0, " scum ": 2.5, " can ": 1.5, " fish": 1.0})
    got, want = (f(lexicon, " ".join(words)) for f in (T.inputs, brute_inputs))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_many_exceptions_take_one_pass(lexicon):
    text = "trash can clown fish " * 100_000
    began = time.perf_counter()
    assert T.Lexicon({" trash ": 4.0, " clown ": 4.0, " fish ": 1.0}).weights(T.fold(text)) == []
    assert time.perf_counter() - began < 10


def test_few_labels_keep_near_the_first_curve():
    assert T.fit_curve(np.zeros((0, 3)), np.zeros(0)) == T.START_CURVE
    one = T.fit_curve(np.array([[1.0, 0.0, 0.0]]), np.array([0]))
    assert max(abs(a - b) for a, b in zip(one, T.START_CURVE, strict=True)) < 0.5


def test_the_fit_settles_far_from_its_start():
    rows, toxic = np.array([[1.0, 0.0, 0.0]] * 60), np.arange(60) % 9 == 0
    intercept, *rest = T.fit_curve(rows, toxic)
    assert abs(1 / (1 + math.exp(-intercept)) - toxic.mean()) < 0.01 and rest == [1.0, 1.0]


def test_null_ids(spark, lexicon):
    docs = spark.createDataFrame([(None, "you idiot", "", None, 1), (None, None, None, None, None)], DOCS)
    assert [r.doc_id for r in T.scored(docs, lexicon).collect()] == [None, None]
    assert T.learn(docs, spark.createDataFrame([(None, 1)], "doc_id long, toxic int")).curve == T.START_CURVE


def test_learning_and_edge_cases(spark, lexicon):
    rows = [(i, ("you moron " if i % 4 == 0 else "nice text ") + "word " * (i % 30), "en", "s", 9) for i in range(400)]
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "clean " * 50_000, "en", "s", 9), (903, "moron " * 50_000, "en", "s", 9), (0, rows[0][1], "en", "s", 9)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    learned = T.learn(docs, labels)
    got = {r.doc_id: r for r in T.scored(docs, learned).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 0 and got[903].predicted == 1
    assert T.scored(docs, learned).count() == len(rows)
    kept = T.clean(docs, learned)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    nothing = T.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.scored(spark.createDataFrame([], DOCS), nothing).count() == 0
    assert T.scored(docs.limit(3), nothing).count() == 3


def test_held_out_accuracy_on_the_given_labels(spark):
    from pathlib import Path

    d = "/root/testdata/sf0.1"
    if not Path(d).exists():
        pytest.skip("no tables here")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.scored(docs, T.learn(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.85
