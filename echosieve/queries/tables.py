"""Engine tables made from the given ones: a text stands for a page, its words for the picture.

Fingerprints are the dear part, so each table of them is made once and stored, as a scan stores features;
joins then read few narrow columns however often they need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators.tables import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hsv(key: Column, size: Column) -> Column:
    return F.struct((key * 37 % 360).cast("double").alias("h"), (size % 100 / 100.0).alias("s"), (key % 50 / 50.0).alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: path, folder_path, size, phash, whash, hsv."""
    docs = table(spark, sf_dir, "documents")
    hashes = H.simhash(docs, "doc_id", "text", phash=1, whash=17)
    rest = docs.select(F.col("doc_id").alias("path"), F.col("source").alias("folder_path"), F.col("n_chars").alias("size"), _hsv(F.col("doc_id"), F.col("n_chars")).alias("hsv"))
    return stored(hashes.withColumnRenamed("doc_id", "path").join(rest, "path"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' coarse fingerprints alone: path, phash."""
    return stored(H.simhash(table(spark, sf_dir, "documents"), "doc_id", "text", phash=1).withColumnRenamed("doc_id", "path"))


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as known ads, with paths below zero."""
    items = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("path"), "text", "item_id")
    found = H.simhash(items, "path", "text", phash=1, whash=17)
    return stored(found.join(items.select("path", _hsv(F.col("item_id"), F.char_length("text")).alias("hsv")), "path"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 16 cells, hashes of equal slices of the text (empty under 16 characters), and a hash of the doc_id as phash."""
    docs = table(spark, sf_dir, "documents")
    step = F.floor(F.length("text") / 16).cast("int")
    cells = F.array(*(H.word_hash(F.substring(F.col("text"), F.lit(i) * step + 1, step)) for i in range(16)))
    cells = F.when(F.length("text") >= 16, cells).otherwise(F.array().cast("array<bigint>"))
    return stored(docs.select(F.col("doc_id").alias("path"), H.word_hash(F.col("doc_id").cast("string")).alias("phash"), cells.alias("grid")))


_BITS = "('0x' || substr(md5({x}), {i}, 16))::UBIGINT"
_SIGNED = "(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)::BIGINT"


def sql_simhash(name: str, source: str, key: str) -> str:
    """Common table ``name(path, phash, whash)`` of 64-bit word SimHashes."""
    return f"""{name}_words AS MATERIALIZED (
  SELECT {key} AS path, {_BITS.format(x="t", i=1)} AS p, {_BITS.format(x="t", i=17)} AS w
  FROM (SELECT *, unnest(string_split(lower(text), ' ')) AS t FROM {source})),
{name} AS MATERIALIZED (
  SELECT path, {_SIGNED.format(u="p")} AS phash, {_SIGNED.format(u="w")} AS whash FROM (
  SELECT path, sum(CASE WHEN p > 0 THEN 1::HUGEINT << i ELSE 0 END)::HUGEINT AS p, sum(CASE WHEN w > 0 THEN 1::HUGEINT << i ELSE 0 END)::HUGEINT AS w
  FROM (SELECT path, i, sum(2 * ((p >> i) & 1)::BIGINT - 1) AS p, sum(2 * ((w >> i) & 1)::BIGINT - 1) AS w
        FROM {name}_words, (SELECT unnest(range(0, 64))::INTEGER AS i) GROUP BY 1, 2) GROUP BY 1))"""


IMAGES = sql_simhash("h", "documents", "doc_id") + """,
images AS MATERIALIZED (
  SELECT h.*, source AS folder_path, n_chars AS size, (doc_id * 37 % 360)::DOUBLE AS hue, (n_chars % 100) / 100.0::DOUBLE AS sat,
    (doc_id % 50) / 50.0::DOUBLE AS val FROM h JOIN documents ON doc_id = path)"""

ADS = sql_simhash("g", "benchmark", "-1 - item_id") + """,
ads AS MATERIALIZED (
  SELECT g.*, (item_id * 37 % 360)::DOUBLE AS hue, (length(text) % 100) / 100.0::DOUBLE AS sat, (item_id % 50) / 50.0::DOUBLE AS val
  FROM g JOIN benchmark ON -1 - item_id = path)"""

def sql_signed_hash(text: str) -> str:
    """64 bits of a text's MD5 as a signed integer."""
    return _SIGNED.format(u=f"{_BITS.format(x=text, i=1)}::HUGEINT")


def sql_turned(fingerprint: str, k: int) -> str:
    """A fingerprint's bits turned left by ``k`` places."""
    u = f"(CASE WHEN {fingerprint} < 0 THEN {fingerprint}::HUGEINT + 18446744073709551616 ELSE {fingerprint} END)"
    return _SIGNED.format(u=f"(({u} & ((1::HUGEINT << {64 - k}) - 1)) << {k} | ({u} >> {64 - k}))")


PAIRS = """pairs AS MATERIALIZED (
  SELECT DISTINCT x.path AS a, y.path AS b, bit_count(xor(x.phash, y.phash))::INTEGER AS d
  FROM (SELECT *, (phash >> (8 * i)) & 255 AS k FROM images, (SELECT unnest(range(0, 8))::INTEGER AS i) WHERE phash <> 0) x
  JOIN (SELECT *, (phash >> (8 * i)) & 255 AS k FROM images, (SELECT unnest(range(0, 8))::INTEGER AS i) WHERE phash <> 0) y
    ON x.i = y.i AND x.k = y.k AND x.path < y.path AND bit_count(xor(x.phash, y.phash)) <= 19)"""


def sql_probe(name: str, left: str, right: str, most: int = 19) -> str:
    """Common table ``name(ad, target, d)``: rows of two tables (path, phash) that share a byte."""
    return f"""{name} AS MATERIALIZED (
  SELECT DISTINCT x.path AS ad, y.path AS target, bit_count(xor(x.phash, y.phash))::INTEGER AS d
  FROM (SELECT *, (phash >> (8 * i)) & 255 AS k FROM {left}, (SELECT unnest(range(0, 8))::INTEGER AS i) WHERE phash <> 0) x
  JOIN (SELECT *, (phash >> (8 * i)) & 255 AS k FROM {right}, (SELECT unnest(range(0, 8))::INTEGER AS i) WHERE phash <> 0) y
    ON x.i = y.i AND x.k = y.k AND bit_count(xor(x.phash, y.phash)) <= {most})"""
