"""Streams of inventory rows into snapshots: idempotent by key, so a batch may come twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import Snapshots


def rows(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def upsert(stream: DataFrame, snapshots: Snapshots, checkpoint: str, newest: str | None = None) -> StreamingQuery:
    """Merge each batch into the snapshots until what there is now is read; see :meth:`Snapshots.merge`."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            snapshots.merge(batch, newest)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_report(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Files and bytes by folder and window of their time, final once ``late`` has passed."""
    by = stream.withWatermark("mtime", late).groupBy(F.window("mtime", window).alias("w"), "folder")
    return by.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).select("folder", F.col("w.start").alias("start"), "files", "bytes")
