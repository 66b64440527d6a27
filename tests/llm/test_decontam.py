import hashlib
import re

from helpers import DOCS, corpus, frame

from echosieve.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, word string, win_id int"


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(rows, items, size):
    wins = {}
    for i, t, *_ in items:
        w = words(t)
        for p in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[tuple(w[p : p + n])] - {None}
        names = sorted(str(x) for x in found)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rows = corpus(7, 60)
    long = rows[-1][1].split()
    items = [(1, rows[0][1]), (2, rows[3][1]), (10, " ".join(long[100:140])), (11, "one-Two"), (12, ""), (13, None), (14, "..."), (15, "ÉX éxNE, zz"), (None, rows[1][1]), (2, rows[5][1])]
    rows += [(900, "a one... tWo b", "en", None, 1), (901, "É one two", "en", None, 1), (902, "ÉX ÉXNE zz ÉX éxne zz", "en", None, 1), (0, rows[0][1], "en", None, 1), (0, "another text", "en", None, 1), (None, rows[3][1], "en", None, 1)]
    return rows, [(i, t, "x", 1) for i, t in items]


def test_against_brute_force(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, ITEMS)
    for size in (10, 3):
        got = sorted((tuple(r) for r in decontam.contaminated(frame(spark, rows), bench, size).collect()), key=str)
        assert got == brute(rows, items, size)


def test_several_passes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontam, "WINDOWS_A_PASS", 20)
    rows, items = case()
    got = sorted((tuple(r) for r in decontam.contaminated(frame(spark, rows), spark.createDataFrame(items, ITEMS), 10).collect()), key=str)
    assert got == brute(rows, items, 10)


def test_passes_and_joins_give_the_same(spark, monkeypatch):
    rows, items = case()
    monkeypatch.setattr(decontam, "WINDOWS_A_PASS", 20)
    for most in (1000, 1):
        monkeypatch.setattr(decontam, "MOST_PASSES", most)
        docs, bench = frame(spark, rows), spark.createDataFrame(items, ITEMS)
        assert sorted((tuple(r) for r in decontam.contaminated(docs, bench, 10).collect()), key=str) == brute(rows, items, 10)
        clean = sorted((r[0] for r in brute(rows, items, 10) if not r[5]), key=str)
        assert sorted((r.doc_id for r in decontam.decontaminated(docs, bench, 10).collect()), key=str) == clean


def test_dropping_keeps_clean_rows(spark):
    rows, items = case()
    docs = frame(spark, rows)
    kept = decontam.decontaminated(docs, spark.createDataFrame(items, ITEMS), 10)
    assert kept.columns == docs.columns
    clean = sorted((r[0] for r in brute(rows, items, 10) if not r[5]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == clean


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(spark.createDataFrame([], DOCS), none).count() == 0
    got = decontam.contaminated(spark.createDataFrame([(1, "a b", "", "", 1)], DOCS), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]


def test_no_python_in_the_plan(spark):
    rows, items = case()
    plan = decontam.contaminated(frame(spark, rows), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
