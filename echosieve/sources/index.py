"""The stored band index of known ads: written anew only when the ads changed, and looked up by equal bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators.band_join import small
from ..operators.diff import digest

VERSION = 1
TURNS = (90, 180, 270)


def entries(ads: DataFrame) -> DataFrame:
    """Bands of each ad's fingerprint and of its turned ones: (path, variant, phash, band, bucket)."""
    base = ads.select("path", F.lit("base").alias("variant"), "phash")
    turned = [ads.select("path", F.lit(f"rot{t}").alias("variant"), F.element_at("phash_rot", F.lit(t)).alias("phash")) for t in TURNS] if "phash_rot" in ads.columns else []
    rows = reduce(DataFrame.unionByName, [base, *turned]).where(H.valid(F.col("phash")))
    return rows.select("*", F.explode(H.bands(F.col("phash"))).alias("b")).select("path", "variant", "phash", "b.band", "b.bucket")


def meta(ads: DataFrame) -> DataFrame:
    """What an index is of: (digest, n, version)."""
    columns = [c for c in ("path", "phash", "phash_rot") if c in ads.columns]
    rows = ads.select("path", *(F.col(c) if c != "phash_rot" else F.sort_array(F.map_values(c)).alias(c) for c in columns[1:]))
    return digest(rows, columns).withColumn("version", F.lit(VERSION))


def rebuild(spark: SparkSession, ads: DataFrame, root: str) -> bool:
    """Write the index below ``root`` unless the one there is of the same ads; whether it was written.

    The index is written first and its description last, so a broken write is seen as no index.
    """
    now = meta(ads).first()
    try:
        was = spark.read.parquet(f"{root}/meta").first()
    except Exception as x:  # noqa: BLE001  a first index: Spark says the path is missing
        if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
            raise
        was = None
    if was is not None and tuple(was) == tuple(now):
        return False
    name = f"{root}/bands-{now.digest[:16]}"
    entries(ads).write.mode("overwrite").partitionBy("band").parquet(name)
    spark.createDataFrame([tuple(now)], "digest string, n bigint, version int").coalesce(1).write.mode("overwrite").parquet(f"{root}/meta")
    return True


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The entries of the index that ``root`` describes."""
    at = spark.read.parquet(f"{root}/meta").first().digest[:16]
    return spark.read.schema("path string, variant string, phash bigint, bucket int, band int").parquet(f"{root}/bands-{at}")


def lookup(index: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    """For each of ``probes(target, phash)`` the ads with a variant that shares a band within ``most`` bits.

    Returns (target, path, d) with the nearest variant's distance.
    """
    rows = probes.where(H.valid(F.col("phash"))).select("target", "phash", F.explode(H.bands(F.col("phash"))).alias("b"))
    left, right = rows.select("target", F.col("phash").alias("h"), "b.band", "b.bucket"), small(index)
    d = H.hamming(F.col("h"), F.col("phash"))
    near = left.join(right, ["band", "bucket"]).where(d <= most).select("target", "path", d.alias("d"))
    return near.groupBy("target", "path").agg(F.min("d").alias("d"))
