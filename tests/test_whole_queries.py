"""Queries over small tables of their own: what the whole job must find."""

from pyspark.sql import functions as F

from echosieve.conf import Settings
from echosieve.operators import funnel, groups, volume
from echosieve.queries import volumes


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_series_are_joined_by_any_folder(spark, tmp_path):
    d = _documents(spark, tmp_path, [(1, "one two three four five", "src0"), (2, "one two three four five", "src11"), (3, "quite another text", "src27")])
    got = {r.skeleton: r.series for r in volumes.series_components(spark, d).collect()}
    assert got == {"src": "src", "src1": "src", "src2": "src2"}


def test_ad_like_needs_no_common_byte(spark):
    """Eight bits apart, one in each byte."""
    rows = [(1, 2**62 - 1, 7), (2, (2**62 - 1) ^ 0x0101010101010101, 7), (3, 1, 7)]
    df = spark.createDataFrame(rows, "path long, phash long, whash long")
    got = funnel.ad_like(df.where("path > 1"), df.where("path = 1"), Settings(use_color_filter=False))
    assert [r.path for r in got.collect()] == [2]
    assert {r.path: r.leader for r in groups.qr_groups(df, 8).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.path: r.leader for r in groups.qr_groups(df, 7).collect()} == {1: 1, 2: 2, 3: 3}


def _features(spark):
    """1: the ad; 2: turned by 90; 3: 20 bits away with equal grids; 4: no common byte, equal grids; 5: 20 bits away, other grids."""
    base, turn = 2**62 - 1, 0x0F0F0F0F0F0F0FFF
    grid, other = [1 << 40 | i for i in range(1, 17)], [1 << 20 | i << 50 for i in range(1, 17)]
    far = base ^ 0xFFFFF00
    rows = [
        (1, "f1", base, {90: turn}, grid), (2, "f2", turn, None, other), (3, "f3", far, None, grid),
        (4, "f4", base ^ 0x0303030303030303, None, grid), (5, "f5", far, None, other),
    ]
    df = spark.createDataFrame(rows, "path long, folder_path string, phash long, phash_rot map<int,bigint>, grid array<bigint>")
    return df.withColumns({"whash": F.lit(7).cast("long"), "hsv": F.expr("named_struct('h', 0D, 's', 0D, 'v', 0.5D)")})


def test_modes_see_turns_and_rescues(spark):
    df = _features(spark)
    settings = Settings(similarity_threshold=70.0)
    got = {(r.a, r.b) for r in funnel.mutual_matches(df, settings).collect()}
    assert {(1, 2), (1, 3)} <= got and (1, 5) not in got
    ads, rest = df.where("path = 1"), df.where("path > 1")
    leaders = ads.select("path", F.col("path").alias("leader"))
    assert {r.item: r.d_p for r in funnel.ad_matches(ads, leaders, rest, settings).collect()} == {2: 0, 3: 20}
    assert {r.path for r in funnel.ad_like(rest, ads, settings).collect()} == {2, 3, 4}


def test_grids_vote_for_ads_without_candidates(spark):
    df = _features(spark).where("path in (1, 4)")
    ads = df.where("path = 1")
    got = funnel.ad_matches(ads, ads.select("path", F.col("path").alias("leader")), df.where("path = 4"), Settings(similarity_threshold=70.0))
    assert [(r.item, r.d_p) for r in got.collect()] == [(4, 16)]


def test_pairs_are_judged_where_they_are_joined(spark):
    """No join follows the one that makes the pairs, but that of leaders with the ads before it."""
    rows = [(i, f"f{i % 3}", 2**62 - 1 - (i % 5), 7, 0.1 * (i % 3)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "path long, folder_path string, phash long, whash long, v double")
    df = df.withColumn("hsv", F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("s"), "v")).drop("v")
    ads, rest = df.where("path <= 4"), df.where("path > 4")
    joins = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    loose = Settings(similarity_threshold=75.0)
    assert joins(funnel.counters(df, loose)) == 1
    assert joins(funnel.mutual_matches(df, loose)) == 1
    assert joins(funnel.ad_matches(ads, ads.select("path", F.col("path").alias("leader")), rest, loose)) == 2
    assert joins(funnel.ad_like(rest, ads, loose)) == 1


def test_exact_matches_alone(spark):
    rows = [(1, "a", 255, 255), (2, "b", 255, 255), (3, "c", 254, 255), (4, "d", 253, 253)]
    df = spark.createDataFrame(rows, "path long, folder_path string, phash long, whash long").withColumn("hsv", F.expr("named_struct('h', 0D, 's', 0D, 'v', 0D)"))
    whole = {(r.a, r.b) for r in funnel.mutual_matches(df, Settings()).where("sim >= 0.9995").collect()}
    assert {(r.a, r.b) for r in funnel.mutual_matches(df, Settings(), 0.9995).collect()} == whole == {(1, 2), (1, 3), (2, 3)}


def test_pairs_of_volumes_are_made_by_many_tasks(spark, monkeypatch):
    """One name that most folders have, paths that repeat, names and paths that are null."""
    monkeypatch.setattr(volume, "BLOCK", 16, raising=False)
    monkeypatch.setattr(volume, "PAIRS_A_TASK", 1000, raising=False)
    rows = [(f"p{i % 190}", "one" if i % 10 else f"s{i % 3}") for i in range(200)] + [("n1", None), ("n2", None), (None, "one"), ("alone", "single")]
    got = volume.intra_pairs(spark.createDataFrame(rows, "path string, skeleton string")).withColumn("task", F.spark_partition_id()).collect()
    whole = [(p, q, s) for p, s in rows for q, t in rows if p is not None and q is not None and s is not None and s == t and p < q]
    assert sorted((r.a, r.b, r.skeleton) for r in got) == sorted(whole)
    assert len({r.task for r in got}) > 10
