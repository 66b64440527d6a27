"""Stopping what runs: the jobs of a scan, and its streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs that start inside can be stopped by :func:`cancel` with the same name, from any thread."""
    spark.addTag(name)
    try:
        yield
    finally:
        spark.removeTag(name)


def cancel(spark: SparkSession, name: str) -> None:
    """Stop all running jobs of a name, and the streams that bear it."""
    spark.interruptTag(name)
    for query in spark.streams.active:
        if query.name == name:
            query.stop()
