"""Folders, archives, backups, settings and plugins on real files."""

import zipfile
from datetime import UTC, datetime, timedelta

import pytest

from echosieve import conf
from echosieve.plans.registry import Registry
from echosieve.sources import archives, inventory
from echosieve.sources.backups import Backups


def test_every_folder_is_walked(spark, tmp_path):
    for folder in ("a/empty", "a/b", "skip/below", "ads/x"):
        (tmp_path / folder).mkdir(parents=True)
    for name in ("1.png", "a/2.txt", "a/b/3.JPG", "a/b/4.png", "ads/x/5.png"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.removeprefix(str(tmp_path)): r for r in inventory.walked(spark, f"file://{tmp_path}", conf.Settings(excluded_folders=("skip",)), ads=f"{tmp_path}/ads").collect()}
    assert {p: r.files for p, r in got.items()} == {"": 1, "/a": 0, "/a/empty": 0, "/a/b": 2}
    assert all(r.mtime and r.ctime for r in got.values())


def test_archives_are_trimmed_with_a_backup(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.cbz", "w") as z:
        for n in ("1.png", "2.png", "note.txt"):
            z.writestr(n, n)
    (tmp_path / "bad.cbz").write_bytes(b"PK broken")
    before = (tmp_path / "a.cbz").read_bytes()
    plan = spark.createDataFrame([(f"{tmp_path}/a.cbz", "2.png"), (f"{tmp_path}/a.cbz", "9.png"), (f"{tmp_path}/bad.cbz", "1.png")], "archive string, inner string")
    dry = {r.archive.rpartition("/")[2]: (r.dropped, r.kept) for r in archives.trim_files(plan, dry=True).collect()}
    assert dry == {"a.cbz": (1, 1), "bad.cbz": (0, None)} and (tmp_path / "a.cbz").read_bytes() == before
    archives.trim_files(plan)
    assert (tmp_path / "a.cbz.bak").read_bytes() == before
    with zipfile.ZipFile(tmp_path / "a.cbz") as z:
        assert sorted(z.namelist()) == ["1.png", "note.txt"]
    assert (tmp_path / "bad.cbz").read_bytes() == b"PK broken"


def test_backups(spark, tmp_path):
    table, now = f"file://{tmp_path}/t", datetime(2024, 5, 1, tzinfo=UTC)
    b = Backups(spark, table, f"file://{tmp_path}/backups")
    for i in range(13):
        spark.createDataFrame([(i,)], "n int").write.mode("overwrite").parquet(table)
        b.create(now + timedelta(days=i))
    assert len(b.names()) == 10 and b.names()[0].startswith("20240504")
    spark.createDataFrame([(99,)], "n int").write.mode("overwrite").parquet(table)
    b.restore()
    assert spark.read.parquet(table).first().n == 12 and spark.read.parquet(f"{table}.before").first().n == 99
    b.restore(b.names()[0])
    assert spark.read.parquet(table).first().n == 3


def test_settings_round_trip(tmp_path):
    path = f"{tmp_path}/s.json"
    assert conf.settings_from(path, {"extract_count": 4}).extract_count == 4
    conf.save_settings(conf.Settings(extract_count=7, excluded_folders=("x",)), path)
    got = conf.settings_from(path, {"extract_count": 4})
    assert got.extract_count == 7 and got.excluded_folders == ("x",) and got == conf.Settings(extract_count=7, excluded_folders=("x",))


def test_plugins_are_discovered(tmp_path):
    (tmp_path / "own.py").write_text("from echosieve.plans.registry import Plugin\nPLUGINS = [Plugin('own', 'Own', lambda t, s: t['images'], ('images',), defaults={'extract_count': 3})]\n")
    r = Registry()
    assert r.discover(str(tmp_path)) == ["own"] and r.settings("own", {"use_whash": False}) == conf.Settings(extract_count=3, use_whash=False)
    (tmp_path / "z.py").write_text("1 / 0")
    with pytest.raises(ImportError, match=r"z\.py"):
        Registry().discover(str(tmp_path))
