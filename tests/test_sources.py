"""Pictures, archives, catalogues, snapshots and streams."""

import io
import json
import sqlite3
import tarfile
import zipfile

import numpy as np

from echosieve.functions import pictures as P
from echosieve.queries.media import png, sample_picture
from echosieve.sources import archives, catalogues, exports, index, inventory, pictures, snapshots
from echosieve.streaming import incremental


def test_picture_features_are_stable_and_tell_pictures_apart():
    a, noisy, other = sample_picture(1), sample_picture(2), sample_picture(4)
    d = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    f = [P.features(x, P.Wanted(rotations=True)) for x in (a, noisy, other)]
    assert d(f[0]["phash"], f[1]["phash"]) <= 10 < d(f[0]["phash"], f[2]["phash"])
    assert len(f[0]["grid"]) == 16 and set(f[0]["phash_rot"]) == {90, 180, 270}
    assert P.phash(np.rot90(P.gray(a), -1)) == f[0]["phash_rot"][90]
    assert len(f[0]["phash_256"]) == 256 and len(f[0]["phash_1024"]) == 1024


def test_mean_hsv_of_plain_colours():
    red = np.zeros((40, 50, 3), np.uint8)
    red[..., 0] = 255
    h, s, v = P.mean_hsv(red)
    assert (round(h), round(s, 3), round(v, 3)) == (0, 1.0, 1.0)
    assert P.is_colorful(np.stack([sample_picture(1)[..., 0], sample_picture(4)[..., 0], sample_picture(7)[..., 0]], axis=-1))
    assert not P.is_colorful(np.full((20, 20, 3), 90, np.uint8))


def test_white_borders_go():
    x = np.full((60, 40, 3), 255, np.uint8)
    x[10:50, 5:25] = 30
    assert P.cropped(x).shape == (40, 20, 3)


def test_pictures_with_a_broken_file(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(sample_picture(1)))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    got = {r.path.rpartition("/")[2]: r for r in pictures.features(spark, f"file://{tmp_path}").collect()}
    assert got["a.png"].phash and got["a.png"].error is None and got["b.png"].error and got["b.png"].phash is None


def test_a_detector_finds_codes():
    f = P.features(sample_picture(1), P.Wanted(detector=lambda image: [[(0, 0), (1, 0), (1, 1)]]))
    assert f["qr_points"] == [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]] and f["features_at"] & 8


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.cbz", "w") as z:
        for n in ("p10.png", "p9.png", "x.txt"):
            z.writestr(n, n)
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        info = tarfile.TarInfo("q.jpg")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ab"))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 broken")
    rows = archives.read(spark, f"file://{tmp_path}", with_content=True).collect()
    assert {(r.inner, bytes(r.content)) for r in rows if not r.error} == {("p10.png", b"p10.png"), ("p9.png", b"p9.png"), ("q.jpg", b"ab")}
    assert [r.archive.rpartition("/")[2] for r in rows if r.error] == ["bad.zip"]
    last = archives.last_members(archives.read(spark, f"file://{tmp_path}"), 1).collect()
    assert {r.inner for r in last} == {"p10.png", "q.jpg"}
    assert [n for n, _, _ in archives.members(archives.trimmed((tmp_path / "z.cbz").read_bytes(), {"p9.png"}), False)] == ["p10.png"]


def test_inventory(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    for n in ("a/1.png", "a/2.txt", "a/skip/3.png"):
        (tmp_path / n).write_bytes(b"x")
    from echosieve.conf import Settings

    got = inventory.files(spark, f"file://{tmp_path}", Settings(excluded_folders=("skip",))).collect()
    assert [(r.name, r.ext, r.length) for r in got] == [("1.png", "png", 1)]


def test_catalogue_files(spark, tmp_path):
    with sqlite3.connect(tmp_path / "c.db") as c:
        c.execute("create table records (id integer, title text)")
        c.execute("insert into records values (1, 'x'), (2, null)")
    assert sorted((r.id, r.title) for r in catalogues.sqlite_table(spark, str(tmp_path / "c.db"), "records").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "d.json").write_text(json.dumps([{"Name": "a/b", "Url": "http://h/1", "Command": "Completed"}, {"Name": "c", "Url": "http://h/2", "Command": "x"}]))
    assert [tuple(r) for r in catalogues.download_urls(spark, f"file://{tmp_path}/d.json", "h/").collect()] == [("a_b", "http://h/1")]
    tree = {"data": [{"namespace": "artist", "data": {"foo_bar": {"name": [{"x": 1, "text": "ＡＢ"}]}}}, {"namespace": "other", "data": {}}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    assert [tuple(r) for r in catalogues.tag_dictionary(spark, f"file://{tmp_path}/t.json").collect()] == [("artist", "ab", "Foo Bar")]
    (tmp_path / "p.jsonl").write_text('{"Name": "a", "Url": "u"}\nbroken\n')
    assert [r.Name for r in catalogues.pending_rows(spark, f"file://{tmp_path}/p.jsonl", "Name string, Url string").where("Name is not null").collect()] == ["a"]
    (tmp_path / "x.csv").write_text("﻿Name,URL\na,u\n", encoding="utf-8")
    assert [tuple(r) for r in catalogues.csv_rows(spark, f"file://{tmp_path}/x.csv", ["Name", "URL", "Status"]).collect()] == [("a", "u", None)]


def test_snapshots_and_stream(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}/s", "path")
    schema = "path string, size long, name string"
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema).write.parquet(f"file://{tmp_path}/in")
    run = lambda: incremental.upsert(incremental.rows(spark, f"file://{tmp_path}/in", schema), s, f"file://{tmp_path}/c").awaitTermination()
    run()
    spark.createDataFrame([("b", None, "z"), ("c", 3, "w")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    run()
    assert sorted(map(tuple, s.read().collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "w")]
    s.delete(spark.createDataFrame([("a",)], "path string"))
    assert s.read().count() == 2 and s.versions() == [1, 2, 3]
    s.roll_back()
    assert s.read().count() == 3


def test_band_index_is_rebuilt_only_when_ads_change(spark, tmp_path):
    schema = "path string, phash long, phash_rot map<int,long>"
    ads = spark.createDataFrame([("a", 0xFF00, {90: 1 << 40, 180: 0}), ("b", None, None)], schema)
    root = f"file://{tmp_path}/index"
    assert index.rebuild(spark, ads, root) and not index.rebuild(spark, ads, root)
    probes = spark.createDataFrame([("x", 0xFF01), ("y", 1 << 40), ("z", 0)], "target string, phash long")
    assert {tuple(r) for r in index.lookup(index.stored(spark, root), probes, 3).collect()} == {("x", "a", 1), ("y", "a", 0)}
    assert index.rebuild(spark, ads.where("path = 'b'"), root) and index.stored(spark, root).count() == 0


def test_exports_and_digests(spark, tmp_path):
    import xxhash

    rows = spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, name string")
    exports.to_csv(rows, f"file://{tmp_path}/r")
    assert sorted(map(tuple, catalogues.csv_rows(spark, f"file://{tmp_path}/r", ["url", "name"]).collect())) == [("u1", "a"), ("u2", "b")]
    exports.queue(spark.createDataFrame([("u2", "c"), ("u3", "d")], "url string, name string"), f"file://{tmp_path}/q")
    assert sorted(map(tuple, exports.flushed(spark, rows, f"file://{tmp_path}/q", "url").collect())) == [("u1", "a", "same"), ("u2", "c", "changed"), ("u3", "d", "added")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"ab" * 50_000)
    assert exports.quick_digests(spark, f"file://{tmp_path}/f").first().qd64 == xxhash.xxh64_hexdigest((b"ab" * 50_000)[: 64 << 10])
