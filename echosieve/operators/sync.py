"""A catalogue kept in step with a listing: differences and the changes they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import DELETED_STATUSES
from ..functions.titles import named_in

#: What a restored record of the catalogue, and a repaired row of the metadata, get as status.
RESTORED, REPAIRED = "non-tag", "tagged"


def is_deleted(rows: DataFrame, prefix: str = "") -> Column:
    """Whether any of a record's marks says deleted; optional columns count where they exist."""
    out = F.coalesce(F.col(f"{prefix}status").isin(*DELETED_STATUSES), F.lit(False))
    if "exist" in rows.columns:
        out = out | F.col(f"{prefix}exist").eqNullSafe(F.lit(0))
    if "hiddenBook" in rows.columns:
        out = out | F.col(f"{prefix}hiddenBook").eqNullSafe(F.lit(1))
    return out


def _not_wholly_deleted(rows: DataFrame) -> Column:
    out = ~F.coalesce(F.col("status").isin(*DELETED_STATUSES), F.lit(False))
    if "exist" in rows.columns:
        out = out | ~F.col("exist").eqNullSafe(F.lit(0))
    if "hiddenBook" in rows.columns:
        out = out | ~F.col("hiddenBook").eqNullSafe(F.lit(1))
    return out


def sync_plan(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``add``, ``soft_delete``, ``restore`` or ``keep`` for each path of ``listing(path)`` or the catalogue."""
    local = listing.select(F.col("path").alias("local")).distinct()
    joined = catalogue.join(local, catalogue.path == local.local, "full_outer")
    action = F.when(F.col("path").isNull(), "add")
    action = action.when(F.col("local").isNull(), F.when(_not_wholly_deleted(catalogue), "soft_delete").otherwise("keep"))
    action = action.when(is_deleted(catalogue), "restore").otherwise("keep")
    return joined.select(F.coalesce("path", "local").alias("path"), action.alias("action"))


def synced(catalogue: DataFrame, plan: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue after a plan; ``new`` has the rows to add, of which known paths are ignored."""
    to = plan.select(F.col("path").alias("key"), "action")
    joined = catalogue.join(to, catalogue.path == to.key, "left")
    gone, back = F.col("action") == "soft_delete", F.col("action") == "restore"
    changes = {"status": (F.lit(DELETED_STATUSES[0]), F.lit(RESTORED)), "exist": (F.lit(0), F.lit(1)), "hiddenBook": (F.lit(1), F.lit(0))}
    kept = joined.select(*(F.when(gone, changes[c][0]).when(back, changes[c][1]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in catalogue.columns))
    added = new.join(plan.where("action = 'add'").select("path"), "path", "left_semi").join(catalogue.select("path"), "path", "left_anti")
    return kept.unionByName(added.dropDuplicates(["path"]), allowMissingColumns=True)


def metadata_changes(catalogue: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata rows whose status must change: (hash, old, new).

    A hash is deleted only if no record that has it lives; hashes of living records are repaired.
    """
    known = catalogue.where("hash is not null")
    listed = F.coalesce(F.col("status").isin(*DELETED_STATUSES), F.lit(False))
    gone = listed | F.col("exist").eqNullSafe(F.lit(0)) if "exist" in catalogue.columns else listed
    live = ~listed & F.col("exist").eqNullSafe(F.lit(1)) if "exist" in catalogue.columns else ~listed
    state = known.groupBy("hash").agg(F.bool_or(gone).alias("gone"), F.bool_or(live).alias("live"))
    joined = metadata.join(state, "hash")
    marked = F.coalesce(F.col("status").isin(*DELETED_STATUSES), F.lit(False))
    new = F.when(F.col("gone") & ~F.col("live") & ~marked, DELETED_STATUSES[0]).when(F.col("live") & marked, REPAIRED)
    return joined.select("hash", F.col("status").alias("old"), new.alias("new")).where("new is not null")


def ghosts(catalogue: DataFrame, inventory: DataFrame) -> DataFrame:
    """Living catalogue records whose path isn't there."""
    return catalogue.where(~is_deleted(catalogue)).join(inventory.select("path").distinct(), "path", "left_anti")


def page_differences(catalogue: DataFrame) -> DataFrame:
    """Records whose page count isn't the file count, with what a repair writes; untagged ones stay."""
    differs = ~F.col("pageCount").eqNullSafe(F.col("filecount")) & F.col("filecount").isNotNull()
    return catalogue.where(differs & ~F.coalesce(F.col("status") == "non-tag", F.lit(False))).withColumn("repaired", F.col("filecount"))


def tag_failures(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(F.col("status") == "tag-failed")


#: The columns of the report of failures.
FAILURE_COLUMNS = ("Title", "Filepath", "URL", "Artist (Romaji)", "Group (Romaji)")


def failure_report(catalogue: DataFrame, artists: dict[str, str], groups: dict[str, str]) -> DataFrame:
    """Records whose tagging failed, as a report: title, path, address, and the artist and group the title names."""
    who = named_in(artists, groups)(F.col("title"))
    rows = tag_failures(catalogue).select("title", "path", "url", who.alias("who"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "path", "url", "who.artist", "who.group")]
    return rows.select(*(c.alias(n) for c, n in zip(text, FAILURE_COLUMNS, strict=True)))


def dashboard(known: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Upsert by key with a flag for each row: ``added``, ``changed`` or ``same``."""
    o, n = known.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    rest = [c for c in known.columns if c != key]
    same = F.lit(True)
    for c in rest:
        same = same & (F.col(f"n.{c}").isNull() | F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")))
    kind = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull() | same, "same").otherwise("changed")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest), kind.alias("change"))


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
