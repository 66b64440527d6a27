"""Copies of stored tables: made, kept for a while, and put back."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession

#: How many of the newest backups stay, and for how many days all do.
NEWEST, DAYS = 10, 7
_STAMP = "%Y%m%dT%H%M%S%f"


class Backups:
    """Backups of the folder ``table`` below ``root``, named by their moment."""

    def __init__(self, spark: SparkSession, table: str, root: str) -> None:
        self.spark, self.table, self.root = spark, table.rstrip("/"), root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._path(self.root).getFileSystem(self._conf)

    def _copy(self, source: str, target: str) -> None:
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        if not util.copy(self._path(source).getFileSystem(self._conf), self._path(source), self._system, self._path(target), False, self._conf):
            raise OSError(f"{source} can't be copied")

    def names(self) -> list[str]:
        """The names of whole backups, the oldest first."""
        if not self._system.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._path(self.root)) if not s.getPath().getName().startswith("_"))

    def create(self, now: datetime | None = None) -> str:
        """Copy the table, under a hidden name until the copy is whole, and let old ones go; the new one's name."""
        name = (now or datetime.now(UTC)).strftime(_STAMP)
        self._copy(self.table, f"{self.root}/_{name}")
        self._system.rename(self._path(f"{self.root}/_{name}"), self._path(f"{self.root}/{name}"))
        self.rotate(now)
        return name

    def rotate(self, now: datetime | None = None) -> list[str]:
        """Delete backups that are neither among the newest few nor of the last days; their names."""
        cutoff = ((now or datetime.now(UTC)) - timedelta(days=DAYS)).strftime(_STAMP)
        gone = [n for n in self.names()[:-NEWEST] if n < cutoff]
        for name in gone:
            self._system.delete(self._path(f"{self.root}/{name}"), True)
        return gone

    def restore(self, name: str | None = None) -> str:
        """Put a backup, the last if none is named, in the table's place; the table as it was comes back if that fails."""
        name = name or self.names()[-1]
        table, aside, fresh = (self._path(f"{self.table}{x}") for x in ("", ".before", ".fresh"))
        system = table.getFileSystem(self._conf)
        for path in (aside, fresh):
            system.delete(path, True)
        self._copy(f"{self.root}/{name}", f"{self.table}.fresh")
        moved = not system.exists(table) or system.rename(table, aside)
        if not moved or not system.rename(fresh, table):
            if system.exists(aside) and not system.exists(table):
                system.rename(aside, table)
            raise OSError(f"{name} can't be put in place")
        return name
