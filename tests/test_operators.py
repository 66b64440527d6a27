"""Groups, changes, selection, volumes and the catalogue on small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from echosieve.conf import Settings
from echosieve.functions import color, labels, paths, titles
from echosieve.operators import diff, groups, selection, sync, volume
from echosieve.plans.registry import Plugin, built_in


def test_components_of_the_chain_and_quirk(spark):
    pairs = [("a", "d"), ("b", "e"), ("b", "g"), ("c", "d"), ("c", "e"), ("g", "h"), ("x", "y"), ("z", "z")]
    got = {r.node: r.leader for r in groups.connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == dict.fromkeys("abcdegh", "a") | {"x": "x", "y": "x"}


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(200)]
    random.Random(1).shuffle(pairs)
    got = groups.connected(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node for r in got} == set(range(201)) and {r.leader for r in got} == {0}


def test_no_pairs(spark):
    assert groups.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_star_groups_against_sequential(spark):
    rng = random.Random(3)
    hashes = [0x5555 << 20]
    for _ in range(60):
        hashes.append(hashes[rng.randrange(len(hashes))] ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)))
    leaders, want = [], {}
    for i, h in enumerate(hashes):
        hit = next((p for p, x in leaders if (x ^ h).bit_count() <= 3), None)
        want[i] = i if hit is None else hit
        if hit is None:
            leaders.append((i, h))
    got = {r.path: r.leader for r in groups.star_groups(spark.createDataFrame(list(enumerate(hashes)), "path long, phash long")).collect()}
    assert got == want


def test_color_gate(spark):
    g = Settings().gate
    hsv = "struct<h:double,s:double,v:double>"
    rows = [("wrap", (359.0, 0.5, 0.5), (1.0, 0.5, 0.1), True), ("hue", (100.0, 0.5, 0.5), (130.0, 0.5, 0.5), False), ("gray", (0.0, 0.17, 0.5), (200.0, 0.1, 0.6), True),
            ("dark", (0.0, 0.1, 0.5), (0.0, 0.1, 0.9), False), ("missing", None, (0.0, 0.1, 0.1), True)]
    df = spark.createDataFrame([(k, a, b) for k, a, b, _ in rows], f"k string, a {hsv}, b {hsv}")
    got = {r.k: r.ok for r in df.select("k", color.passes(F.col("a"), F.col("b"), F.lit(9), F.lit(False), g).alias("ok")).collect()}
    assert got == {k: ok for k, _, _, ok in rows}
    strict = df.select("k", color.passes(F.col("a"), F.col("b"), F.lit(9), F.lit(False), g, missing_fails=True).alias("ok"))
    assert not {r.k: r.ok for r in strict.collect()}["missing"]


def test_labels_round_half_to_even(spark):
    df = spark.createDataFrame([(0.8125,), (1.0,), (0.984375,)], "s double").select(labels.label(F.col("s")).alias("l"))
    assert [r.l for r in df.collect()] == ["81.2%", "100.0%", "98.4%"]
    assert spark.range(1).select(labels.percent(F.lit("98.4% (x)")).alias("p")).first().p == 98.4


def test_paths(spark):
    row = spark.range(1).select(
        paths.archive_of(F.lit("zip:///a/b!c.zip!d/e.png")).alias("archive"), paths.inner_of(F.lit("zip:///a/b!c.zip!d/e.png")).alias("inner"),
        paths.container(F.lit("zip:///a/b.zip!e.png")).alias("c"), paths.extension(F.lit("/a.b/c.JPG")).alias("ext"),
        (F.array_join(paths.natural_key(F.lit("p10")), "") > F.array_join(paths.natural_key(F.lit("P9")), "")).alias("order"),
        paths.excluded(F.lit("/x/foo2"), ("/x/foo",)).alias("sibling"), paths.excluded(F.lit("/x/foo/y"), ("/x/foo",)).alias("child"),
    ).first()
    assert tuple(row) == ("/a/b!c.zip", "d/e.png", "/a", "jpg", True, False, True)


def test_skeletons(spark):
    names = {
        "[Circle (Artist)] Title Vol. 03 [DL]": ("title", 3), "Ｔｉｔｌｅ　第１２巻": ("title", 12), "[x]": ("[x]", None), "A": ("a", None),
        "My_Story - 7": ("my story", None), "第3巻": ("第3巻", 3),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("c", titles.composed(F.col("n")))
    got = {r.n: (r.s, r.v) for r in df.select("n", titles.skeleton(F.col("c")).alias("s"), titles.volume_number(F.col("c")).alias("v")).collect()}
    assert got["[Circle (Artist)] Title Vol. 03 [DL]"] == ("title", 3) and got["A"] == ("a", None) and got["My_Story - 7"] == ("my story", None)
    assert got["[x]"] == ("[x]", None) and got["Ｔｉｔｌｅ　第１２巻"][1] == 12 and got["第3巻"][1] == 3


def test_fuzzy_lookup(spark):
    closest = titles.close_match(["alpha beta", "gamma"])
    df = spark.createDataFrame([("Alpha  Beta".replace("  ", " "),), ("alpha betta",), ("zz",), (None,), ("",)], "q string").select("q", closest(F.col("q")).alias("m"))
    assert {r.q: r.m for r in df.collect()} == {"Alpha Beta": "alpha beta", "alpha betta": "alpha beta", "zz": None, None: None, "": None}


def test_first_fit_depends_on_order():
    a, b = np.array([0, 1], dtype=np.int64), np.array([1, 7], dtype=np.int64)
    assert volume.first_fit(a, b, 1) == 1 and volume.first_fit(a[::-1], b, 0) == 1 and volume.first_fit(a, b, 3) == 2


def test_subtree_prune_hides_below_old(spark):
    rows = [("r", 1), ("r/a", 1), ("r/a/x", 9), ("r/b", 9), ("r/b/x", 9), ("r/b/y", 2)]
    got = diff.subtree_kept(spark.createDataFrame(rows, "path string, ts int"), F.lit(5))
    assert {r.path for r in got.collect()} == {"r", "r/b", "r/b/x"}


def test_prefix_delete_spares_siblings(spark):
    df = spark.createDataFrame([("foo",), ("foo/a",), ("foo2",)], "path string")
    assert [r.path for r in diff.without_prefix(df, "foo").collect()] == ["foo2"]


def test_metadata_spares_hashes_that_live(spark):
    cat = spark.createDataFrame([(1, "h1", "deleted", 0), (2, "h1", "ok", 1), (3, "h2", "file_deleted", 0), (4, "h3", "ok", 1)], "path long, hash string, status string, exist int")
    meta = spark.createDataFrame([("h1", "x"), ("h2", "x"), ("h3", "deleted")], "hash string, status string")
    assert {(r.hash, r.new) for r in sync.metadata_changes(cat, meta).collect()} == {("h2", "file_deleted"), ("h3", "tagged")}


def test_sync_with_and_without_optional_columns(spark):
    cat = spark.createDataFrame([(1, "ok"), (2, "deleted"), (3, "ok"), (4, "deleted")], "path long, status string")
    here = spark.createDataFrame([(1,), (2,), (9,)], "path long")
    assert {r.path: r.action for r in sync.sync_plan(here, cat).collect()} == {1: "keep", 2: "restore", 3: "soft_delete", 4: "keep", 9: "add"}


def test_selection_mutual(spark):
    rows = [("f/a", "f/bb", "f", "f", 1, 1), ("f/aaa", "f/b", "f", "f", 1, 1), ("g/a", "h/bbb", "g", "h", 5, 5), ("i/a", "j/a", "i", "j", 1, 1)]
    got = selection.select_mutual(spark.createDataFrame(rows, "a string, b string, folder_a string, folder_b string, size_a long, size_b long"))
    assert {r.path for r in got.collect()} == {"f/bb", "f/aaa", "h/bbb"}


def test_registry(spark):
    r = built_in()
    assert "mutual_comparison" in r.names("mode")
    hsv = (1.0, 0.5, 0.5)
    images = spark.createDataFrame([("f/a", "f", 9, 9, hsv), ("g/b", "g", 9, 9, hsv), ("h/c", "h", 2**40 - 1, 3, hsv)], "path string, folder_path string, phash long, whash long, hsv struct<h:double,s:double,v:double>")
    got = r.run("mutual_comparison", {"images": images}).collect()
    assert [(x.leader, x.item, x.label) for x in got] == [("f/a", "g/b", "100.0%")]
    r.add(Plugin("own", "Own", lambda t, s: t["images"].limit(1), ("images",)))
    assert r.run("own", {"images": images}).count() == 1
