"""Incremental state: what changed, what is kept, what must be done again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folder_changes(live: DataFrame, state: DataFrame, needed: int = 0) -> DataFrame:
    """Classify folders of ``live(path, ts)`` against ``state(path, ts, scanned_count)``.

    ``new``, ``ghost`` (in the state alone), ``changed`` (another time, or fewer pages scanned than
    ``needed`` now asks for), ``unchanged``.
    """
    now, was = live.select("path", F.col("ts").alias("now")), state.select(F.col("path").alias("known"), F.col("ts").alias("was"), "scanned_count")
    joined = now.join(was, now.path == was.known, "full_outer")
    kind = F.when(F.col("known").isNull(), "new").when(F.col("path").isNull(), "ghost")
    kind = kind.when(~F.col("now").eqNullSafe(F.col("was")) | (F.coalesce("scanned_count", F.lit(0)) < needed), "changed").otherwise("unchanged")
    return joined.select(F.coalesce("path", "known").alias("path"), kind.alias("kind"))


def ghost_policy(ghosts: DataFrame, window: bool, preserve: bool, cleanup: bool, prune_images: bool) -> DataFrame:
    """What happens to vanished folders ``ghosts(path, exists)``: ``keep``, ``drop_state`` or ``drop_all``.

    A scan of a time window that preserves what lies outside keeps them, but with ``cleanup`` drops the state of
    those that no longer exist, and with ``prune_images`` their pictures too. Any other scan drops both of all.
    """
    if not (window and preserve):
        return ghosts.withColumn("action", F.lit("drop_all"))
    gone = "drop_all" if prune_images else "drop_state"
    return ghosts.withColumn("action", F.when(F.lit(cleanup) & ~F.coalesce("exists", F.lit(False)), gone).otherwise("keep"))


def restored(cached: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Cached files of unchanged folders."""
    return cached.join(unchanged.select(F.col("path").alias("folder_path")), "folder_path", "left_semi")


def task_list(scanned: DataFrame, cached: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Scanned and restored paths, each once, without quarantined ones."""
    return scanned.select("path").union(cached.select("path")).distinct().join(quarantine.select("path"), "path", "left_anti")


def cache_plan(tasks: DataFrame, inventory: DataFrame, cache: DataFrame, feature_bit: int, use_digest: bool = True) -> DataFrame:
    """What to do with each path of ``tasks``: ``hit``, ``upgrade`` (a hit that lacks a digest), ``recalc``,
    ``purge`` (gone, but cached) or ``gone``.

    ``inventory(path, mtime, qd64)`` is what there is, ``cache(path, mtime, qd64, features_at)`` what is known.
    """
    now = inventory.select("path", F.col("mtime").alias("now"), F.col("qd64").alias("digest"))
    was = cache.select("path", F.col("mtime").alias("was"), F.col("qd64").alias("known"), "features_at")
    joined = tasks.select("path").join(now, "path", "left").join(was, "path", "left")
    same = F.col("now").eqNullSafe(F.col("was")) & (F.col("features_at").bitwiseAND(F.lit(feature_bit)) != 0)
    digest_ok = F.col("known").isNull() | F.col("known").eqNullSafe(F.col("digest")) if use_digest else F.lit(True)
    hit = F.when(F.col("known").isNull() & F.lit(use_digest), "upgrade").otherwise("hit")
    plan = F.when(F.col("now").isNull(), F.when(F.col("was").isNull(), "gone").otherwise("purge"))
    return joined.select("path", plan.when(F.coalesce(same & digest_ok, F.lit(False)), hit).otherwise("recalc").alias("plan"))


def stale(items: DataFrame, digest: Column) -> DataFrame:
    """Items that the catalogue of this digest hasn't been compared with."""
    return items.where(~F.col("last_ad_digest").eqNullSafe(digest))


def marked(items: DataFrame, found: DataFrame, digest: Column) -> DataFrame:
    """Write the catalogue's digest on items without a match, so that the next run skips them."""
    hit = found.select(F.col("path").alias("hit")).distinct()
    joined = items.join(hit, items.path == hit.hit, "left")
    return joined.withColumn("last_ad_digest", F.when(F.col("hit").isNull(), digest).otherwise(F.col("last_ad_digest"))).drop("hit")


def subtree_kept(folders: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Folders of ``folders(path, ts)`` whose own time and all whose ancestors' are at ``start`` or later.

    An old folder hides its subtree; the topmost folder (without a listed ancestor) hides nothing and
    stays. ``end`` only filters a folder itself.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = folders.select("path", F.explode(ups).alias("up")).where("up <> path")
    above = folders.select(F.col("path").alias("up"), F.col("ts").alias("up_ts"))
    depth = F.size(F.split("up", "/"))
    seen = up.join(above, "up").groupBy("path").agg(F.min(depth).alias("top"))
    roots = up.join(above, "up").join(seen.select("path", "top"), "path").where(depth > F.col("top"))
    old = roots.groupBy("path").agg(F.min("up_ts").alias("oldest"))
    joined = folders.join(seen.select("path", "top"), "path", "left").join(old, "path", "left")
    kept = F.col("top").isNull() | ((F.col("ts") >= start) & F.coalesce(F.col("oldest") >= start, F.lit(True)))
    inside = F.lit(True) if end is None else F.col("ts") <= end
    return joined.where(kept & inside).select("path", "ts")


def leaves(folders: DataFrame) -> DataFrame:
    """Paths that no other path lies below: an anti join on every path's ancestors, no prefix compare."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = folders.where(F.size(parts) > 1).select(F.explode(ups).alias("path")).distinct()
    return folders.select("path").distinct().join(above, "path", "left_anti")


def empty_folders(folders: DataFrame, files: DataFrame, junk: tuple[str, ...]) -> DataFrame:
    """Folders without files, or with files that don't count alone."""
    real = files.where(~F.lower("name").isin(*junk)).select(F.col("folder").alias("path")).distinct()
    return folders.select("path").distinct().join(real, "path", "left_anti")


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: columns of ``new`` that aren't null replace those of ``old``."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    both = set(new.columns)
    return joined.select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in both else F.col(f"o.{c}").alias(c) for c in old.columns))


def without_prefix(items: DataFrame, top: str) -> DataFrame:
    """Delete a folder and all below it; ``foo2`` isn't below ``foo``."""
    top = top.rstrip("/")
    return items.where((F.col("path") != top) & ~F.col("path").startswith(top + "/"))


#: Hashes that a digest takes in at once.
DIGEST_ROWS = 1 << 16


def digest(items: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of all rows' values in order of their own hashes, as one row ``digest``, ``n``.

    Rows are hashed where they are and sums of those hashes would not do, as a sum hides which rows
    changed; so hashes are sorted within buckets of a common first byte, and the buckets' digests again.
    A bucket is one stream of sorted hashes of which a batch is held, so the definition is the same at any
    number of rows.
    """
    most = DIGEST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, n, out = None, None, 0, []
        for batch in batches:
            whole = b"".join(batch.column("h").to_pylist())
            first = np.frombuffer(whole, dtype=np.uint8)[::32]
            cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi and first[lo] != own:
                    if sha is not None:
                        out.append((f"{own:02x}", sha.hexdigest(), n))
                    own, sha, n = int(first[lo]), hashlib.sha256(), 0
                for at in range(lo, hi, most):
                    end = min(hi, at + most)
                    sha.update(((b"," if n else b"") + whole[32 * at : 32 * end].hex(",", 32).encode()))
                    n += end - at
        if sha is not None:
            out.append((f"{own:02x}", sha.hexdigest(), n))
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["b", "h", "n"])

    hashed = items.select(F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)).alias("h"))
    level = hashed.repartition(F.substring("h", 1, 1)).sortWithinPartitions("h").mapInArrow(run, "b string, h string, n long")
    named = F.sort_array(F.collect_list(F.concat("b", "h")))
    return level.agg(F.sha2(F.array_join(named, ","), 256).alias("digest"), F.sum("n").alias("n"))


def catalogue_digests(items: DataFrame, threshold: float, version: str) -> DataFrame:
    """Digests of a catalogue of ads ``items(rel, size, mtime, phash)`` as one row.

    ``manifest_digest`` is of the files (name, size, whole seconds), ``content_digest`` of the valid
    fingerprints, ``params_digest`` of what a comparison depends on, and ``catalogue_digest`` of the last two: it
    changes where items must be compared again.
    """
    files = items.select("rel", F.col("size").cast("long").alias("size"), F.floor(F.col("mtime")).cast("long").alias("mtime"))
    pages = items.where("phash is not null and phash <> 0").select(F.lower(F.lpad(F.hex("phash"), 16, "0")).alias("phash"))
    params = F.sha2(F.to_json(F.struct(F.lit(version).alias("engine_version"), F.lit(threshold).alias("similarity_threshold"))), 256)
    manifest, content = digest(files, ["rel", "size", "mtime"]), digest(pages, ["phash"])
    both = manifest.select(F.col("digest").alias("manifest_digest")).join(content.select(F.col("digest").alias("content_digest")), F.lit(True), "left")
    named = both.withColumn("params_digest", params)
    return named.withColumn("catalogue_digest", F.sha2(F.concat("content_digest", "params_digest"), 256))


def folder_signature(children: DataFrame) -> DataFrame:
    """SHA-1 of each folder's direct children, by name and time: (folder, signature)."""
    line = F.concat_ws("|", F.lower("name"), F.unix_micros("mtime"))
    return children.groupBy("folder").agg(F.sha1(F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("signature"))


def protect_root(to_scan: DataFrame, root: str, files: DataFrame) -> DataFrame:
    """Folders to scan without the root, unless pictures lie in the root itself."""
    loose = files.where(F.col("folder") == root).select(F.lit(root).alias("path")).limit(1)
    return to_scan.where(F.col("path") != root).unionByName(to_scan.where(F.col("path") == root).join(F.broadcast(loose), "path", "left_semi"))


def with_new_children(to_scan: DataFrame, new: DataFrame, live: DataFrame, window: Column) -> DataFrame:
    """Folders to scan and the live folders below new ones whose own time (``ts``) the window holds."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = live.where(window).select("path", F.explode(ups).alias("up")).join(new.select(F.col("path").alias("up")), "up", "left_semi").select("path")
    return to_scan.select("path").union(below).distinct()


def fallback_folders(unchanged: DataFrame, cached: DataFrame) -> DataFrame:
    """Unchanged leaf folders of which nothing is cached: they must be scanned after all."""
    missing = unchanged.select("path").join(cached.select(F.col("folder_path").alias("path")).distinct(), "path", "left_anti")
    return leaves(missing)
