"""Catalogues in other stores, dictionaries and lists in JSON and CSV."""

from __future__ import annotations

import sqlite3
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import sanitized


def sqlite_table(spark: SparkSession, path: str, table: str, rows_a_batch: int = 50_000) -> DataFrame:
    """A table of a local SQLite file, whatever columns it has. Such files live on one machine: it's read there."""
    with sqlite3.connect(path) as connection:
        columns = [r[1] for r in connection.execute(f'PRAGMA table_info("{table}")')]
        parts = list(pd.read_sql_query(f'SELECT * FROM "{table}"', connection, chunksize=rows_a_batch))
    data = pd.concat(parts) if parts else pd.DataFrame(columns=columns, dtype=str)
    return spark.createDataFrame(data.astype(object).where(data.notna(), None)) if len(data) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a database, read in ranges of a key."""
    options = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


def download_urls(spark: SparkSession, path: str, host: str) -> DataFrame:
    """Completed downloads of a host: (name, url), names as folders spell them, the last URL of each."""
    rows = spark.read.schema("Name string, Url string, Command string").option("multiLine", True).json(path)
    # A list is one document and so one task, in which rows are numbered as they come.
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    kept = rows.where((F.col("Command") == "Completed") & F.contains("Url", F.lit(host)) & (F.coalesce(F.trim("Name"), F.lit("")) != ""))
    return kept.groupBy(sanitized(F.col("Name")).alias("name")).agg(F.max_by("Url", "place").alias("url"))


def _first_text(value: object) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict) and isinstance(value.get("name"), str):
        return value["name"]
    for item in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if found := _first_text(item):
            return found
    return None


def tag_names(root: dict) -> list[tuple[str, str, str]]:
    """(namespace, key, name) of a tag dictionary: keys are composed lower-case originals, names Latin."""
    out = {}
    for section in root.get("data") or []:
        if isinstance(section, dict) and section.get("namespace") in ("artist", "group") and isinstance(section.get("data"), dict):
            for tag, entry in section["data"].items():
                text = _first_text(entry.get("name")) if isinstance(entry, dict) else None
                if text and text.strip():
                    key = unicodedata.normalize("NFKC", text).lower().strip()
                    out[section["namespace"], key] = tag.replace("_", " ").title()
    return [(ns, key, name) for (ns, key), name in out.items()]


def tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A tag dictionary file as (namespace, key, name); it's one JSON document, parsed in one task."""
    import json

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField(c, StringType()) for c in ("namespace", "key", "name")])

    def run(batches):
        for batch in batches:
            rows = [r for text in batch["value"] for r in tag_names(json.loads(text))]
            yield pd.DataFrame(rows, columns=["namespace", "key", "name"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, as texts; a missing column is null and a byte-order mark ignored."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def pending_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Queued rows, one JSON object a line; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
