"""Results that earlier tests took over from a wrong reading, and bounds that used to cut them."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echosieve.conf import Settings
from echosieve.functions import pictures, titles
from echosieve.operators import band_join, diff, groups, selection, sync, tail, upkeep
from echosieve.plans import modes
from echosieve.sources import catalogues, exports, snapshots


@pytest.mark.parametrize(("window", "preserve", "cleanup", "prune", "there", "gone"), [
    (False, False, False, False, "drop_all", "drop_all"), (False, True, True, True, "drop_all", "drop_all"), (True, False, False, False, "drop_all", "drop_all"),
    (True, True, False, False, "keep", "keep"), (True, True, False, True, "keep", "keep"), (True, True, True, False, "keep", "drop_state"), (True, True, True, True, "keep", "drop_all"),
])
def test_ghost_policy(spark, window, preserve, cleanup, prune, there, gone):
    ghosts = spark.createDataFrame([("a", True), ("b", False)], "path string, exists boolean")
    got = {r.path: r.action for r in diff.ghost_policy(ghosts, window, preserve, cleanup, prune).collect()}
    assert got == {"a": there, "b": gone}


def test_restored_records_and_repaired_metadata_differ(spark):
    cat = spark.createDataFrame([(1, "h", "deleted"), (2, "g", "ok")], "path long, hash string, status string")
    here = spark.createDataFrame([(1,), (2,)], "path long")
    after = sync.synced(cat, sync.sync_plan(here, cat), cat.limit(0))
    assert {r.path: r.status for r in after.collect()} == {1: "non-tag", 2: "ok"}
    meta = spark.createDataFrame([("g", "deleted")], "hash string, status string")
    assert [(r.hash, r.new) for r in sync.metadata_changes(cat, meta).collect()] == [("g", "tagged")]


def test_copy_names_never_collide(spark):
    rows = [(1, "x.png"), (2, "x.png"), (3, "x_1.png"), (4, "y"), (5, "x.jpg"), (6, "x_1_1.png"), (7, "a.b.png"), (8, "y.png")]
    taken = spark.createDataFrame([("ad_x_2.png",), ("ad_y.png",), ("other.png",)], "name string")
    got = {r.path: r.copy_name for r in tail.unique_names(spark.createDataFrame(rows, "path long, name string"), "name", taken).collect()}
    assert got == {1: "ad_x.png", 2: "ad_x_1.png", 3: "ad_x_1_1.png", 4: "ad_y_1.png", 5: "ad_x.jpg", 6: "ad_x_1_1_1.png", 7: "ad_a.b.png", 8: "ad_y_2.png"}


def test_merge_takes_whole_rows_and_the_newest(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}/s", "k")
    schema = "k long, name string, n long"
    s.merge(spark.createDataFrame([(1, "a", 9), (1, "b", 1)], schema))
    assert [tuple(r) for r in s.read().collect()] == [(1, "b", 1)]
    s.merge(spark.createDataFrame([(1, "late", 0), (2, "c", 5), (2, "d", 4)], schema), newest="n")
    assert sorted(tuple(r) for r in s.read().collect()) == [(1, "b", 1), (2, "c", 5)]
    (tmp_path / "s" / "v=3-broken").mkdir()
    (tmp_path / "s" / "v=3-broken" / "part-0.parquet").write_bytes(b"half")
    assert s.write(spark.createDataFrame([(7, "z", 1)], schema)) == 3
    assert [tuple(r) for r in s.read().collect()] == [(7, "z", 1)] and s.versions() == [1, 2, 3]


def test_the_last_url_and_the_last_queued_row_count(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"Name": "a", "Url": "http://h/9", "Command": "Completed"}, {"Name": "a", "Url": "http://h/1", "Command": "Completed"}]')
    assert [r.url for r in catalogues.download_urls(spark, f"file://{tmp_path}/d.json", "h/").collect()] == ["http://h/1"]
    schema, q = "url string, a string, n long", f"file://{tmp_path}/q"
    exports.queue(spark.createDataFrame([("u", "a", 9), ("u", "b", 1)], schema).coalesce(1), q)
    known = spark.createDataFrame([], schema)
    assert [tuple(r)[:3] for r in exports.flushed(spark, known, q, "url").collect()] == [("u", "b", 1)]
    exports.emptied(spark, q)
    assert not (tmp_path / "q").exists()


def test_votes_without_limits(spark):
    grid = list(range(1, 17))
    ads = spark.createDataFrame([(-1, 1, grid)], "ad long, phash long, grid array<long>")
    gallery = spark.createDataFrame([(i, 1, grid) for i in range(1200)], "target long, phash long, grid array<long>")
    none = spark.createDataFrame([], "ad long")
    assert band_join.grid_votes(ads, gallery, none).count() == 0
    assert band_join.grid_votes(ads, gallery, none, bucket=None).count() == 200
    assert band_join.grid_votes(ads, gallery, none, bucket=None, per_ad=None, total=None).count() == 1200


def test_volumes_leave_ads_out_before_the_tail(spark):
    """The last 150 pages are ads; archives in one folder are volumes each; full-width names are composed."""
    ads = [(f"ads/{i}.png", 10_000 + i) for i in range(150)]
    volume = lambda path, first: [(path.format(n=i), first + (i << 20)) for i in range(1, 21)]
    pages = volume("lib/Title Vol. 3/{n}.png", 1) + [(f"lib/Title Vol. 3/9{i:03d}.png", h) for i, (_, h) in enumerate(ads)]
    pages += volume("zip://lib/[x] Ｔｉｔｌｅ 第３巻.cbz!{n}.png", 1) + volume("zip://lib/Other.cbz!{n}.png", 1 << 50)
    frame = lambda rows: spark.createDataFrame(rows, "path string, phash long")
    got = modes.volumes({"images": frame(pages), "ads": frame(ads)}, Settings()).collect()
    assert [(r.a, r.b, r.matched) for r in got] == [("lib/Title Vol. 3", "lib/[x] Ｔｉｔｌｅ 第３巻.cbz", 12)] or {r.matched for r in got} == {12} and len(got) == 1


@pytest.mark.parametrize("most", [0, 2, 3, 5, 7, 12])
def test_close_pairs_against_all_pairs(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(-(2**63), 2**63, 40)
    hashes = [int(b) for b in base] + [int(b ^ sum(1 << int(i) if i < 63 else -(2**63) for i in set(rng.integers(0, 64, rng.integers(0, 10))))) for b in np.repeat(base, 4)] + [0]
    df = spark.createDataFrame([(i, h, hashes[-1 - i]) for i, h in enumerate(hashes)], "path long, phash long, whash long")
    d = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    share = lambda x, y: any((x ^ y) >> 8 * i & 255 == 0 for i in range(8))
    pairs = [(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if hashes[a] and hashes[b]]
    want = {(a, b, d(hashes[a], hashes[b])) for a, b in pairs if d(hashes[a], hashes[b]) <= most and share(hashes[a], hashes[b])}
    assert {tuple(r) for r in band_join.band_pairs(df, most).collect()} == want
    if most <= 7:
        wave = {(a, b, d(hashes[a], hashes[b])) for a, b in pairs if d(hashes[a], hashes[b]) <= 19 and share(hashes[a], hashes[b]) and hashes[-1 - a] and hashes[-1 - b] and d(hashes[-1 - a], hashes[-1 - b]) <= most}
        assert {tuple(r) for r in band_join.alike_pairs(df, most).collect()} == want | wave


def test_very_many_copies_are_one_item(spark):
    df = spark.range(30_000).select(F.col("id").alias("path"), F.when(F.col("id") < 29_990, 77).otherwise(F.col("id") * 104_729).cast("long").alias("phash"))
    got = {r.path: r.leader for r in groups.duplicate_groups(df, 3).collect()}
    assert {p: g for p, g in got.items() if p < 29_990} == dict.fromkeys(range(29_990), 0)
    assert groups.star_groups(df).where("path < 29990 and leader <> 0").count() == 0
    assert groups.qr_groups(df, 3).where("leader = 0").first().n >= 29_990


def test_display_order_numbers_all_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("leader"), (F.col("id") % 7).alias("best"), (F.col("id") % 5 == 0).alias("ad_like"))
    got = selection.display_order(df.repartition(9)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001))
    assert [r.leader for r in got] == sorted(range(1000), key=lambda i: (i % 5 != 0, -(i % 7), i))
    assert selection.display_order(df.limit(0)).count() == 0


def test_digest_levels(spark, monkeypatch):
    df = spark.range(500).select("id")
    whole = diff.digest(df, ["id"]).first()
    assert whole.n == 500 and whole.digest == diff.digest(df.repartition(7), ["id"]).first().digest
    monkeypatch.setattr(diff, "DIGEST_ROWS", 1)
    deep = diff.digest(df, ["id"]).first()
    assert deep.n == 500 and deep.digest == diff.digest(df.repartition(5), ["id"]).first().digest
    assert deep.digest != diff.digest(df.where("id <> 3"), ["id"]).first().digest


def test_digest_is_one_definition_at_any_size(spark, monkeypatch):
    rows = [hashlib.sha256(f'{{"id":{i}}}'.encode()).hexdigest() for i in range(3000)]
    of = {b: ",".join(sorted(h for h in rows if h[:2] == b)) for b in {h[:2] for h in rows}}
    wanted = hashlib.sha256(",".join(sorted(b + hashlib.sha256(x.encode()).hexdigest() for b, x in of.items())).encode()).hexdigest()
    for most in (1 << 16, 1):
        monkeypatch.setattr(diff, "DIGEST_ROWS", most)
        assert tuple(diff.digest(spark.range(3000).select("id"), ["id"]).first()) == (wanted, 3000)


def test_hashes_by_definition():
    """Cosine bits and Haar bits by their definitions, not by the code under test."""
    rng = np.random.default_rng(4)
    plane = rng.integers(0, 256, (32, 32)).astype(np.float64)
    cos = np.array([[np.cos(np.pi * u * (2 * x + 1) / 64) for x in range(32)] for u in range(8)])
    low = np.array([[sum(plane[y, x] * cos[v, y] * cos[u, x] for y in range(32) for x in range(32)) for u in range(8)] for v in range(8)])
    want = (low > np.median(low)).ravel()
    assert pictures.frequency_bits(plane, 8).ravel().tolist() == want.tolist()


def test_code_regions():
    image = np.full((600, 500, 3), 255, np.uint8)
    image[100:200, 50:150] = (np.random.default_rng(1).integers(0, 2, (20, 20)).repeat(5, 0).repeat(5, 1) * 255)[..., None]
    image[400:404, 20:480] = 0
    (box,) = pictures.code_regions(image)
    assert abs(box[0] - 50) <= 8 and abs(box[1] - 100) <= 8 and abs(box[2] - 100) <= 16 and abs(box[3] - 100) <= 16
    assert pictures.code_regions(np.full((50, 50, 3), 7, np.uint8)) == []


def test_title_names_over_all_tags():
    artists, known = {"known one": "Known-One"}, {"circle": "Circle!"}
    who = lambda t: titles.artist_and_group(t, artists, known)
    assert who("[DL] [circle (known one)] x [other]") == ("Known-One", "Circle!")
    assert who("[first][second][third]") == ("First", "Second")
    assert who("[circle] [it's ok] t") == ("It'S Ok", "Circle!") and who("[日本] [zed]") == ("日本", "Zed") and who(None) == ("", "")


def test_upkeep(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"C:\\\\a": {"size": 3, "phash": "ff"}, "/b": null}')
    assert [tuple(r) for r in upkeep.migrated(spark, f"file://{tmp_path}/old.json", "size bigint, phash string").collect()] == [("c:/a", 3, "ff")]
    old, like = spark.createDataFrame([(1, "x")], "a int, gone string"), spark.createDataFrame([], "a long, b string")
    assert [tuple(r) for r in upkeep.with_columns_of(old, like).collect()] == [(1, None)]
    for n in ("images-1", "images-2", "ads-1"):
        (tmp_path / "c" / n).mkdir(parents=True)
    assert upkeep.invalidated(spark, f"file://{tmp_path}/c", "images") == ["images-1", "images-2"] and [p.name for p in (tmp_path / "c").iterdir()] == ["ads-1"]


def test_cancelled_jobs_stop(spark):
    import threading
    import time

    from echosieve.plans import control

    failed = []

    def work():
        try:
            with control.cancellable(spark, "own"):
                spark.range(0, 10**12, 1, 4).selectExpr("sum(id * id % 7)").collect()
        except Exception as x:  # noqa: BLE001
            failed.append(str(x))

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(100):
        time.sleep(0.3)
        control.cancel(spark, "own")
        if not thread.is_alive():
            break
    thread.join(60)
    assert failed and not thread.is_alive()


def test_pictures_in_archives_have_the_features_of_loose_ones(spark):
    from echosieve.queries import media

    got = {r.page: r for r in media.archive_pictures(spark, "").collect()}
    assert set(got) == {f"a{i}.cbz!page{k}.png" for i in range(4) for k in range(max(0, i - 1), i + 2)}
    for i in range(4):
        for k in range(max(0, i - 1), i + 2):
            own, want = got[f"a{i}.cbz!page{k}.png"], pictures.features(media.sample_picture(5 * i + k))
            assert own.error is None and (own.phash, own.whash) == (want["phash"], want["whash"])


def test_features_of_fixed_pictures(spark):
    """Every column of the query over generated pictures against features of the same pixels; turns are of turned pixels."""
    from echosieve.queries import media

    for r in media.phash_image(spark, "").collect():
        image = media.sample_picture(int(r.name[1:3]))
        want = pictures.features(image, pictures.Wanted(rotations=True))
        assert (r.width, r.height, r.phash, r.whash, r.cells) == (128, 96, want["phash"], want["whash"], 16)
        assert r.phash_180 == pictures.phash(np.rot90(pictures.gray(image), 2)) and r.error is None
