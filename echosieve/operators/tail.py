"""Ranks within containers: last pages, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import natural_key


def last_pages(pages: DataFrame, container: str, name: str, n: int | Column) -> DataFrame:
    """The last ``n`` pages of each container in natural order of names, with ``rank`` from the end."""
    order = Window.partitionBy(container).orderBy(natural_key(F.col(name)).desc(), F.col(name).desc())
    return pages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def page_limit(target: int, first_scan: int, is_new: Column) -> Column:
    """How many last pages of a container are read: more, if so set, the first time its folder is seen."""
    return F.greatest(F.lit(target), F.when(is_new, first_scan).otherwise(0))


def batch_order(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Files of a folder in one task and side by side, in order of names, so that slow disks read on."""
    return files.repartition(folder).sortWithinPartitions(folder, F.lower(name))


def last_by(rows: DataFrame, container: str, order: list[Column], n: int | Column) -> DataFrame:
    """The last ``n`` rows of each container by ``order`` (falling), with their rank from the end."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(container).orderBy(*order))).where(F.col("rank") <= n)


def trim_plan(members: DataFrame, container: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` members of each container that has more than ``n``: what a trim would delete."""
    w = Window.partitionBy(container)
    ranked = members.withColumn("members", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where((F.col("members") > n) & (F.col("rank") <= n))


def retained(backups: DataFrame, group: str, ts: str, newest: int, cutoff: Column) -> DataFrame:
    """Backups that stay: the newest few of each group, and all since ``cutoff``."""
    order = Window.partitionBy(group).orderBy(F.desc(ts), F.desc(F.col("backup")))
    return backups.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= newest) | (F.col(ts) >= cutoff))


def unique_names(items: DataFrame, name: str, taken: DataFrame | None = None) -> DataFrame:
    """``copy_name`` of each item for a library: ``ad_<base>.<ext>``, or with ``_<i>`` after the base while that is taken.

    Items come in path order; ``taken(name)`` are the names the library has already. A name without extension
    gets ``.png``. Only names with the same base, but for such numbers, and extension can collide, so those are
    named together, one after the other, in a stream.
    """
    ext = F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)
    base = F.when(ext == "", F.col(name)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    ext = F.when(ext == "", ".png").otherwise(ext)
    root = lambda c: F.regexp_replace(c, r"(_[0-9]+)+$", "")
    kind = items.schema["path"].dataType.simpleString()
    asked = items.select("path", base.alias("base"), ext.alias("ext"), root(base).alias("root"), F.lit(1).alias("turn"))
    if taken is not None:
        known = taken.where(F.col("name").startswith("ad_"))
        stem, last = F.regexp_replace(F.substring("name", 4, 1 << 20), r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
        asked = asked.unionByName(known.select(F.lit(None).cast(kind).alias("path"), stem.alias("base"), last.alias("ext"), root(stem).alias("root"), F.lit(0).alias("turn")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, nexts = None, set(), {}
        for b in batches:
            paths, names = [], []
            for path, base, ext, root, turn in zip(*(b.column(c).to_pylist() for c in ("path", "base", "ext", "root", "turn")), strict=True):
                if (root, ext) != group:
                    group, used, nexts = (root, ext), set(), {}
                if not turn:
                    used.add(base)
                    continue
                i, found = nexts.get(base, 0), base
                while (found := f"{base}_{i}" if i else base) in used:
                    i += 1
                nexts[base] = i + 1
                used.add(found)
                paths.append(path)
                names.append(f"ad_{found}{ext}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, b.schema.field("path").type), pa.array(names, pa.string())], ["path", "copy_name"])

    dealt = asked.repartition("root", "ext").sortWithinPartitions("root", "ext", "turn", "path")
    named = dealt.mapInArrow(run, f"path {kind}, copy_name string")
    return items.join(named, "path")
