"""Reports and queues: CSV files, rows that wait for a file that was locked, digests of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import dashboard

#: Bytes at the head of a file that its quick digest covers.
QUICK_BYTES = 64 << 10
#: Stores that a task can open by itself; files of others are read whole by Spark.
READABLE = ("/", "file:", "hdfs://", "s3://", "gs://")


def to_csv(rows: DataFrame, path: str) -> None:
    """Write a report with a header; readers see it when Spark has committed it, whole."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def queue(rows: DataFrame, path: str) -> None:
    """Append rows that can't be delivered now, as JSON lines."""
    rows.write.mode("append").json(path)


def flushed(spark: SparkSession, known: DataFrame, path: str, key: str) -> DataFrame:
    """The known rows with what is queued merged in.

    Of rows queued twice the last one counts, whole: that of the latest file, and in it of the last line.
    """
    waiting = spark.read.schema(known.schema).json(path)
    place = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    rest = [c for c in known.columns if c != key]
    last = waiting.select("*", place.alias("_place")).groupBy(key).agg(F.max_by(F.struct(*rest), "_place").alias("_last"))
    return dashboard(known, last.select(*(F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in known.columns)), key)


def emptied(spark: SparkSession, path: str) -> None:
    """Delete a queue that has been delivered, so that the next delivery doesn't repeat it."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def quick_digests(spark: SparkSession, root: str) -> DataFrame:
    """XXH64 (seed 0, hexadecimal) of the first 64 KiB of each file: (path, qd64)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^file:/{1,3}", "/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri in b.column("uri").to_pylist():
                system, at = pafs.FileSystem.from_uri(uri)
                with system.open_input_stream(at, compression=None) as file:
                    out.append(xxhash.xxh64_hexdigest(file.read(QUICK_BYTES)))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "qd64"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [xxhash.xxh64_hexdigest(x.as_py()) for x in b.column("head")]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], ["path", "qd64"])

    if root.startswith(READABLE):
        # Paths alone are listed; tasks open the files and read their heads.
        return found.select(plain.alias("path"), F.regexp_replace("path", "^file:/{1,3}", "file:///").alias("uri")).mapInArrow(read, "path string, qd64 string")
    return found.select(plain.alias("path"), F.substring("content", 1, QUICK_BYTES).alias("head")).mapInArrow(run, "path string, qd64 string")
