"""Tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TEMPORARY: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without that setting gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _TEMPORARY:
        _TEMPORARY.append(tempfile.mkdtemp(prefix="echosieve-"))
        atexit.register(shutil.rmtree, _TEMPORARY[0], True)
    return f"file://{_TEMPORARY[0]}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table and return it as read, without its lineage."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
