"""Files and folders as a table, without their content."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import Settings
from ..functions import dates, paths
from ..operators.tables import stored as written

_WALKED = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("ctime", pa.timestamp("us", "UTC")), ("files", pa.int64()), ("below", pa.list_(pa.string()))])


def files(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Files below ``root`` that settings allow: path, folder, name, ext, length, mtime.

    Only metadata columns are selected, so no content is read; date filters are pushed to the source.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/{1,3}", "/")
    rows = found.select(path.alias("path"), F.col("length"), F.col("modificationTime").alias("mtime"))
    rows = rows.withColumns({"folder": paths.folder(F.col("path")), "name": paths.basename(F.col("path")), "ext": paths.extension(F.col("path"))})
    kept = rows.where(F.col("ext").isin(*settings.image_extensions)) if settings.image_extensions else rows
    kept = kept.where(~paths.excluded(F.col("folder"), settings.excluded_folders))
    return kept.where(dates.in_window(F.col("mtime"), settings.start_date, settings.end_date))


def walked(spark: SparkSession, root: str, settings: Settings = Settings(), ads: str | None = None) -> DataFrame:  # noqa: B008
    """Every folder from ``root`` down, itself and empty ones included: (path, mtime, ctime, files).

    A level is listed at a time, a folder a row, in tasks; the driver holds no names. Excluded folders, and that of
    the known ads, hide what lies below. ``files`` counts pictures; ``ctime`` is null where a store has none.
    """
    rules = settings.excluded_folders + ((ads,) if ads else ())
    kinds = settings.image_extensions

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                system, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
                own, found = system.get_file_info(at), system.get_file_info(pafs.FileSelector(at))
                below = [f for f in found if f.type == pafs.FileType.Directory]
                pictures = sum(f.type == pafs.FileType.File and (not kinds or f.extension.lower() in kinds) for f in found)
                local = isinstance(system, pafs.LocalFileSystem)
                stat = os.stat(at) if local else None
                when = datetime.fromtimestamp(stat.st_mtime, UTC) if local else own.mtime
                rows.append((at, when, datetime.fromtimestamp(stat.st_ctime, UTC) if local else None, pictures, sorted(f.path for f in below)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _WALKED.types, strict=True)], schema=_WALKED)

    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    out = []
    while True:
        listed = written(level.mapInArrow(children, "path string, mtime timestamp, ctime timestamp, files bigint, below array<string>"))
        out.append(listed.drop("below"))
        level = listed.select(F.explode("below").alias("path")).where(~paths.excluded(F.col("path"), rules))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        level = level.repartition(spark.sparkContext.defaultParallelism)


def folders(inventory: DataFrame) -> DataFrame:
    """Folders that hold files, with the time of the newest and their number."""
    return inventory.groupBy(F.col("folder").alias("path")).agg(F.max("mtime").alias("ts"), F.count(F.lit(1)).alias("files"))


def stored(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, roots: tuple[str, ...] = ()) -> DataFrame:
    """A persisted inventory table, filtered where it is read."""
    rows = spark.read.parquet(path).where(dates.in_window(F.col("mtime"), start, end))
    below = F.lit(not roots)
    for root in roots:
        below = below | F.col("folder").startswith(root.rstrip("/") + "/") | (F.col("folder") == root.rstrip("/"))
    return rows.where(below)
