"""Upkeep of stored tables: backfills, quarantine, hints, migrations, invalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def without_folder(images: DataFrame) -> DataFrame:
    """Rows that a backfill would change: (missing)."""
    return images.agg(F.count_if(F.coalesce(F.col("folder_path"), F.lit("")) == "").alias("missing"))


def backfilled(images: DataFrame) -> DataFrame:
    """Rows with their folder where it was null or empty: an archive's own folder for a page in it."""
    own = F.coalesce(F.nullif("folder_path", F.lit("")), paths.container(F.col("path")))
    return images.withColumn("folder_path", own)


def quarantined(known: DataFrame, failures: DataFrame) -> DataFrame:
    """The quarantine after a scan: what it held and the paths that failed, in their normal form, each once."""
    new = failures.select(paths.normalized(F.col("path")).alias("path"))
    return known.select("path").unionByName(new).distinct()


def counts(catalogue: DataFrame, images: DataFrame) -> DataFrame:
    """How much there is, as one row: records, records without tags, pictures and folders that hold some."""
    records = catalogue.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "non-tag").alias("untagged"))
    pages = images.agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("folder_path").alias("folders"))
    return records.join(pages, F.lit(True))


def hints(stored: DataFrame, signatures: DataFrame) -> DataFrame:
    """Stored folders (root, signature, path) that hold files, as far as their root's signature is the same now."""
    return stored.join(signatures.select("root", "signature"), ["root", "signature"], "left_semi").select("root", "path")


def migrated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table from an older cache file, one JSON object of records by path: (path, and the columns of ``schema``).

    What isn't such a record is left out. Such a file is one document and so one task.
    """
    text = spark.read.text(path, wholetext=True)
    record = F.from_json("value", f"map<string, struct<{schema}>>")
    rows = text.select(F.explode(record).alias("path", "r")).where("r is not null")
    return rows.select(paths.normalized(F.col("path")).alias("path"), "r.*")


def with_columns_of(old: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of an older table as a newer one has them: missing columns are null, unknown ones go."""
    return old.select(*((F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def invalidated(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Delete the stored tables below ``root`` whose names begin with ``prefix``; their names."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(context._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(top)] if system.exists(top) else []
    gone = [p for p in found if p.getName().startswith(prefix)]
    for p in gone:
        system.delete(p, True)
    return sorted(p.getName() for p in gone)
