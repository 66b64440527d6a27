"""Versioned snapshots of keyed tables: merge, delete, roll back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import merged, without_prefix


class Snapshots:
    """A keyed table as Parquet folders ``v=<n>-<name>``; a reader sees the last complete one.

    A write goes to a folder of its own name and counts once Spark has put its marker there, so a failed write
    leaves the last version as it was and blocks no later one. Of two writers that take the same number the one
    whose folder comes first by name has it, for every reader; the other finds out and tells.
    """

    def __init__(self, spark: SparkSession, root: str, key: str) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _paths(self) -> list[tuple[int, str]]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        found = [s.getPath() for s in system.listStatus(root)]
        done = [p for p in found if p.getName().startswith("v=") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        first: dict[int, str] = {}
        for number, path in sorted((int(p.getName()[2:].partition("-")[0]), p.toString()) for p in done):
            first.setdefault(number, path)
        return sorted(first.items())

    def versions(self) -> list[int]:
        return [n for n, _ in self._paths()]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The last version, or the one asked for; None if there is none."""
        found = dict(self._paths())
        if not found:
            return None
        return self.spark.read.parquet(found[max(found) if version is None else version])

    def write(self, rows: DataFrame) -> int:
        version, name = max(self.versions(), default=0) + 1, uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/v={version}-{name}")
        if not dict(self._paths())[version].endswith(name):
            raise RuntimeError(f"another writer has made version {version}")
        return version

    def merge(self, rows: DataFrame, newest: str | None = None) -> int:
        """Upsert rows by key; of rows that repeat a key one counts, whole: the greatest by its columns in order.

        With ``newest`` that column comes first in this order, and a row whose value there isn't above that of
        the stored row changes nothing, so batches may come late or twice.
        """
        rest = [c for c in rows.columns if c != self.key]
        order = [newest, *(c for c in rest if c != newest)] if newest else rest
        last = rows.groupBy(self.key).agg(F.max(F.struct(*order)).alias("_last"))
        rows = last.select(*(F.col(self.key) if c == self.key else F.col(f"_last.{c}").alias(c) for c in rows.columns))
        old = self.read()
        if old is not None and newest:
            was = old.select(F.col(self.key).alias("_key"), F.col(newest).alias("_was"))
            later = F.col("_was").isNull() | (F.col(newest) > F.col("_was"))
            rows = rows.join(was, F.col(self.key) == F.col("_key"), "left").where(later).select(*rows.columns)
        return self.write(rows if old is None else merged(old, rows, self.key))

    def delete(self, keys: DataFrame) -> int:
        return self.write(self.read().join(keys.select(self.key), self.key, "left_anti"))

    def delete_below(self, top: str) -> int:
        return self.write(without_prefix(self.read(), top))

    def roll_back(self) -> int:
        """Write the version before the last as a new one."""
        return self.write(self.read(self.versions()[-2]))
