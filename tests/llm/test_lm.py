import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import DOCS, corpus, frame

from echosieve.llm import lm


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows):
    c = Counter()
    for i, t, *_ in rows:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def test_base_against_brute_force(spark):
    rows = [*corpus(11), (None, "no id here", "", None, 0)]
    rows.append(rows[0])
    got = sorted(lm.scores(frame(spark, rows)).collect(), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    left = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert left == Counter((*w[:5], round(w[5], 6)) for w in want)
    assert all(r.score < 0 for r in got)


def test_context_helps(spark):
    rows = [(i, "the cat sat on the mat and " * 5 + f"word{i % 40} x{i % 3}", "", None, 0) for i in range(300)]
    got = [r for r in lm.scores(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert got and all(r.score > r.base_score / 2 for r in got)


def _learned(spark, rows, how):
    df = spark.createDataFrame([(False, t) for t in rows], "held_out boolean, text string")
    words = lm.word_counts(df)
    words.cache()
    return lm.learn(df, words, how), {r.h: r.c for r in words.collect()}


def test_distributions_sum_to_one(spark):
    rows = ["a b a b c a b", "b a b a", "c c c a b a b d"] * 10 + ["e"]
    model, counts = _learned(spark, rows, lm.Tree(depth=2, rare=1e-3, gain=0.1))
    assert len(model.states.keys)
    symbols = [*np.array(list(counts), dtype=np.int64).view(np.uint64).tolist(), int(lm.END), 12345]
    c = np.array([*counts.values(), len(rows), 0], dtype=np.int64)
    root = model.root(c)
    assert abs((10.0**root).sum() - 1) < 1e-9
    names = {w: int(next(lm.word_hashes(pa.array([w])))[1][0]) for w in "abcd"}
    for context in (["a"], ["b"], ["a", "b"], ["b", "a"], ["c", "c"], ["d", "zz"]):
        total = 0.0
        for s, r in zip(symbols, root, strict=True):
            flat = np.array([int(lm.START), *(names.get(w, 999) for w in context), s], dtype=np.uint64)
            total += 10.0 ** model.predict(flat, np.array([0]), np.append(np.zeros(len(flat) - 1), r))[-1]
        assert abs(total - 1) < 1e-9


def test_longest_state_predicts(spark):
    rows = ["x a b c", "y a b d"] * 200
    model, counts = _learned(spark, rows, lm.Tree(depth=3, rare=1e-3, gain=1.0))
    key = {w: int(next(lm.word_hashes(pa.array([w])))[1][0]) for w in "xyabcd"}
    flat = np.array([int(lm.START), *(key[w] for w in "xabc")], dtype=np.uint64)
    root = model.root(np.array([0, *(counts[np.uint64(key[w]).view(np.int64)] for w in "xabc")]))
    assert model.predict(flat, np.array([0]), root)[-1] > math.log10(0.9)


def test_edge_tables(spark):
    assert lm.scores(spark.createDataFrame([], DOCS)).count() == 0
    only = next(i for i in range(100) if held(i))
    r = lm.scores(spark.createDataFrame([(only, "a b", "", None, 0)], DOCS)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    r = lm.scores(spark.createDataFrame([(0, None, "", None, 0)], DOCS)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 1, 1)


def test_contexts_that_are_rare_in_a_large_corpus(spark):
    """What occurs five times in 600,000 tokens is learned, as in a small corpus."""
    rng = np.random.default_rng(1)
    rows = [" ".join(f"w{i}" for i in rng.integers(0, 1000, 6000)) for _ in range(100)] + ["alpha beta gamma"] * 5
    model, counts = _learned(spark, rows, lm.Tree())
    key = [int(h) for h in next(lm.word_hashes(pa.array(["alpha beta gamma"])))[1]]
    flat = np.array([int(lm.START), *key], dtype=np.uint64)
    root = model.root(np.array([0, *(counts[np.uint64(k).view(np.int64)] for k in key)]))
    assert model.predict(flat, np.array([0]), root)[-1] > math.log10(0.8)


def test_blocks_score_as_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4096)
    rows = [r for r in corpus(5) if r[1]]
    docs = frame(spark, rows)
    model, counts = _learned(spark, [t for i, t, *_ in rows if not held(i)], lm.Tree(gain=0.5))
    texts = sum(not held(i) for i, *_ in rows)
    counts[int(lm.END.view(np.int64))] = texts
    assert len(model.states.keys) > 10
    got = {r.doc_id: r.score for r in lm.scores(docs, lm.Tree(gain=0.5)).collect()}
    for i, text, *_ in rows:
        words = next(lm.word_hashes(pa.array([text])))[1]
        flat = np.concatenate(([lm.START], words, [lm.END])).astype(np.uint64)
        root = model.root(np.array([counts.get(int(h), 0) for h in flat.view(np.int64)]))
        assert abs(model.predict(flat, np.array([0]), root).sum() - got[i]) < 1e-6


def test_many_rows_of_one_doc_id(spark):
    rows = [(777, "a b c a b", "", None, 0)] * 200 + [(None, f"a {i % 3}", "", None, 0) for i in range(150)] + corpus(3, 20)
    got = lm.scores(frame(spark, rows)).collect()
    left = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert left == Counter((*w[:5], round(w[5], 6)) for w in brute(rows))
    assert len({r.score for r in got if r.doc_id == 777}) == 1


def brute_scores(rows, how):
    """Scores by the definition: counts of windows, states by divergence, the longest state predicts."""
    train = [["<", *(t or "").encode().lower().split(), ">"] for i, t, *_ in rows if not held(i)]
    counts = [Counter() for _ in range(how.depth + 2)]
    for t in train:
        for n in range(1, how.depth + 2):
            counts[n].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    words = Counter({w: c for (w,), c in counts[1].items() if w not in ("<", ">")})
    tokens, different = sum(words.values()) + len(train), len(words) + bool(train)
    one, two = (sum(c == k for c in words.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, one / max(1, one + 2 * two)))
    root = lambda s: (counts[1][s,] - discount) / tokens if counts[1][s,] and s != "<" else discount * different / tokens
    kept, p = [{}, {w: c for w, c in counts[1].items()}], {w: (c - discount) / tokens for w, c in counts[1].items()}
    rests, states = {}, [set() for _ in range(how.depth + 2)]
    for n in range(2, how.depth + 2):
        own = {w: c for w, c in counts[n].items() if c >= how.least and kept[n - 1].get(w[:-1], 0) >= how.least and w[1:] in kept[n - 1]}
        kept.append(own)
        by = {}
        for w, c in own.items():
            by.setdefault(w[:-1], []).append((w, c))
        for ctx, after in by.items():
            t = kept[n - 1][ctx]
            rests[ctx] = (t - sum(c for _, c in after) + how.discount * len(after)) / t
            if sum(c * math.log(c / t / p[w[1:]]) for w, c in after) > how.gain * (1 + len(after)):
                states[n - 1].add(ctx)
        p |= {w: (c - how.discount) / kept[n - 1][w[:-1]] + rests[w[:-1]] * p[w[1:]] for w, c in own.items()}
    for n in range(how.depth, 1, -1):
        states[n - 1] |= {ctx[1:] for ctx in states[n] if ctx in kept[n]}
    out = []
    for i, t, *_ in rows:
        flat, total = ["<", *(t or "").encode().lower().split(), ">"], 0.0
        for at in range(1, len(flat)):
            factor, n = 1.0, how.depth
            for n in range(min(how.depth, at), -1, -1):
                ctx = tuple(flat[at - n : at])
                if n == 0:
                    total += math.log10(factor * root(flat[at]))
                elif ctx in states[n]:
                    if (*ctx, flat[at]) in kept[n + 1]:
                        total += math.log10(factor * p[(*ctx, flat[at])])
                        break
                    factor *= rests[ctx]
        out.append((i, total))
    return out


def test_scores_against_brute_force(spark):
    rows = [*corpus(21, 80), *((500 + i, "the cat sat on the mat " * (i % 4 + 1) + f"and x{i % 5} left", "", None, 0) for i in range(60))]
    for how in (lm.Tree(), lm.Tree(depth=2, gain=0.5), lm.Tree(gain=0.0, discount=0.3)):
        want = sorted(brute_scores(rows, how))
        got = sorted((r.doc_id, r.score) for r in lm.scores(frame(spark, rows), how).collect())
        assert all(a == b and abs(x - y) < 1e-6 * max(1, abs(y)) for (a, x), (b, y) in zip(got, want, strict=True))


def test_no_table_of_windows(spark, monkeypatch):
    """Names cross the network in arrays; neither windows nor contexts are rows that joins would sort."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 15)
    rows, write = [], lm.written

    def written(df, tag, *more):
        out = write(df, tag, *more)
        rows.append((tag, out.count()))
        return out

    monkeypatch.setattr(lm, "written", written)
    text = " ".join(f"w{i}" for i in range(2000))
    got = lm.scores(spark.createDataFrame([(i, text, "", None, 0) for i in range(12)], DOCS)).count()
    assert got == 12 and all(n < 1000 for _, n in rows), rows


def test_order_of_hashes():
    """As a stable sort has it, also where names differ in their last bits alone."""
    rng = np.random.default_rng(4)
    whole = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for keys in (whole, whole[:0], whole[:1], whole % np.uint64(50), whole // np.uint64(1 << 53), np.append(whole, whole[:100] ^ np.uint64(1))):
        assert (lm.ordered(keys) == np.argsort(keys, kind="stable")).all()
        names, place, first = lm.distinct(keys)
        want, ahead, inverse = np.unique(keys, return_index=True, return_inverse=True)
        assert (names == want).all() and (place == inverse).all() and (first == ahead).all()
