"""Candidates that share a byte of their fingerprint, as an equi-join that needs no distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import COARSE_D, GRID_CELLS, RESCUE_CELLS, RESCUE_D, VOTE_BUCKET, VOTE_PER_AD, VOTE_TOTAL
from ..functions import hashing as H

#: Up to so many bits fingerprints always agree in a byte.
BANDED = 7
#: Rows of the smaller side that a broadcast may hold.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows; else left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_bands(items: DataFrame, fingerprint: str = "phash") -> DataFrame:
    """A row for each band of each valid fingerprint, with ``band`` and ``bucket``."""
    return items.where(H.valid(F.col(fingerprint))).select("*", F.explode(H.bands(F.col(fingerprint))).alias("_b")).select("*", "_b.band", "_b.bucket").drop("_b")


def _edges(most: int) -> list[tuple[int, int]]:
    """Where the bands of a small bound lie: as wide as the pigeonhole principle allows."""
    n = most + 1
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


def _band(fingerprint: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < 64 else fingerprint


def close_pairs(items: DataFrame, most: int, fingerprint: str = "phash", *also: str) -> DataFrame:
    """All pairs ``a < b`` of ``items(path, ...)`` whose fingerprints differ in at most ``most`` bits, 7 at most.

    Such fingerprints agree in one of ``most + 1`` bands, which are wide, so candidates stay near the result.
    A pair is given by the lowest such band alone. Returns (a, b, d) and, for each of ``also``, the columns
    ``x_<name>`` and ``y_<name>``.
    """
    edges, h = _edges(most), F.col(fingerprint)
    each = F.array(*(F.struct(F.lit(i).alias("band"), _band(h, *e).cast("bigint").alias("bucket")) for i, e in enumerate(edges)))
    rows = items.where(H.valid(h)).select("path", h.alias("_h"), *also, F.explode(each).alias("_b")).select("path", "_h", *also, "_b.band", "_b.bucket")
    a, b = rows.alias("x"), rows.alias("y")
    x = F.col("x._h").bitwiseXOR(F.col("y._h"))
    first = F.coalesce(*(F.when(_band(x, *e) == 0, F.lit(i)) for i, e in enumerate(edges)))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.path") < F.col("y.path"))
    joined = a.join(b, same & (F.bit_count(x) <= most) & (first == F.col("x.band")))
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in also for s in "xy"]
    return joined.select(F.col("x.path").alias("a"), F.col("y.path").alias("b"), F.bit_count(x).alias("d"), *sides)


def band_pairs(items: DataFrame, most: int = COARSE_D, key: str = "path", own: Column | None = None) -> DataFrame:
    """Pairs ``a < b`` of ``items(path, phash)`` that share a byte and differ in at most ``most`` bits.

    A pair that shares several bands is given by the lowest alone, so no distinct is needed. Up to 7 bits all
    pairs share a byte, and wider bands give the same result. Returns (a, b, d) and, if ``own`` is given, its
    values ``x`` and ``y`` of both sides: rows carry them into the join, so that pairs needn't be moved to be judged.
    """
    also = [] if own is None else ["_own"]
    named = items.select(F.col(key).alias("path"), "phash", *(own.alias(c) for c in also))
    if most <= BANDED:
        return close_pairs(named, most, "phash", *also).withColumnsRenamed({"x__own": "x", "y__own": "y"})
    rows = with_bands(named)
    a, b = rows.alias("x"), rows.alias("y")
    d = H.hamming(F.col("x.phash"), F.col("y.phash"))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.path") < F.col("y.path"))
    joined = a.join(b, same & (d <= most) & (H.first_common_band(F.col("x.phash"), F.col("y.phash")) == F.col("x.band")))
    sides = [F.col(f"{s}.{c}").alias(s) for c in also for s in "xy"]
    return joined.select(F.col("x.path").alias("a"), F.col("y.path").alias("b"), d.alias("d"), *sides)


def alike_pairs(items: DataFrame, most: int, own: Column | None = None) -> DataFrame:
    """The pairs of :func:`band_pairs` up to the coarse distance of which ``phash`` or ``whash`` differ in at most ``most`` bits.

    For bounds up to 7 both are joined by wide bands; a pair that both find is given by the first.
    """
    also = [] if own is None else ["_own"]
    near = band_pairs(items, most, own=own)
    waves = items.where(H.valid(F.col("phash"))).select("path", "phash", "whash", *(own.alias(c) for c in also))
    waves = close_pairs(waves, most, "whash", "phash", *also).withColumnsRenamed({"x__own": "x", "y__own": "y"})
    d, shared = H.hamming(F.col("x_phash"), F.col("y_phash")), H.first_common_band(F.col("x_phash"), F.col("y_phash")).isNotNull()
    kept = waves.withColumn("d", d).where((F.col("d") > most) & (F.col("d") <= COARSE_D) & shared)
    return near.unionByName(kept.select(*near.columns))


#: Broadcasts that ads may take, one after the other, before they are shuffled.
BROADCAST_BLOCKS = 8


def probe_pairs(ads: DataFrame, gallery: DataFrame, most: int = COARSE_D) -> DataFrame:
    """Pairs of ``ads(ad, phash, ...)`` and ``gallery(target, phash, ...)`` that share a byte, within ``most`` bits.

    Other columns are kept. Ads meet the gallery in blocks of a size that a broadcast may hold, in which case
    pairs stay where the gallery's rows are; or by a shuffle, if there are many.
    """
    left, right = with_bands(ads), with_bands(gallery).alias("y")
    d = H.hamming(F.col("x.phash"), F.col("y.phash"))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket"))
    sides = [F.col(f"{s}.{c}") for s, t in (("x", ads), ("y", gallery)) for c in t.columns if c not in ("ad", "target", "phash")]

    def met(part: DataFrame) -> DataFrame:
        joined = right.join(part.alias("x"), same & (d <= most) & (H.first_common_band(F.col("x.phash"), F.col("y.phash")) == F.col("x.band")))
        return joined.select("x.ad", "y.target", d.alias("d"), *sides)

    blocks = -(-left.limit(BROADCAST_ROWS * BROADCAST_BLOCKS + 1).count() // BROADCAST_ROWS) or 1
    if blocks > BROADCAST_BLOCKS:
        return met(left)
    parts = (left.where(F.pmod(F.xxhash64("ad"), F.lit(blocks)) == i) if blocks > 1 else left for i in range(blocks))
    return reduce(DataFrame.unionByName, (met(F.broadcast(part)) for part in parts))


def all_pairs(ads: DataFrame, gallery: DataFrame, most: int) -> DataFrame:
    """Pairs of ``ads(ad, phash)`` and ``gallery(target, phash)`` within ``most`` bits, whatever bytes they share.

    All are compared: the ads meet the gallery in blocks of a size that a broadcast may hold.
    """
    left = ads.where(H.valid(F.col("phash"))).select("ad", F.col("phash").alias("h"))
    right = gallery.where(H.valid(F.col("phash"))).select("target", "phash")
    blocks = -(-left.count() // BROADCAST_ROWS) or 1
    d = H.hamming(F.col("h"), F.col("phash"))
    parts = (left.where(F.pmod(F.xxhash64("ad"), F.lit(blocks)) == i) for i in range(blocks))
    return reduce(DataFrame.unionByName, (right.join(F.broadcast(p), d <= most).select("ad", "target", d.alias("d")) for p in parts))


def rotation_pairs(ads: DataFrame, gallery: DataFrame, most: int = COARSE_D) -> DataFrame:
    """As :func:`probe_pairs` by the upright fingerprint, judged by the nearest of ``turns`` (an array).

    A turn that is null or zero falls back to the upright fingerprint.
    """
    left, right = small(with_bands(ads)).alias("x"), with_bands(gallery).alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket"))
    turned = F.transform(F.col("x.turns"), lambda t: H.hamming(F.when(H.valid(t), t).otherwise(F.col("x.phash")), F.col("y.phash")))
    d0 = H.hamming(F.col("x.phash"), F.col("y.phash"))
    joined = right.join(left, same & (H.first_common_band(F.col("x.phash"), F.col("y.phash")) == F.col("x.band")))
    out = joined.select("x.ad", "y.target", d0.alias("d0"), F.least(d0, F.coalesce(F.array_min(turned), d0)).alias("d"))
    return out.where(F.col("d") <= most)


def grid_rescues(pairs: DataFrame) -> DataFrame:
    """Mark pairs (phash_a, phash_b, grid_a, grid_b) too far apart whose grids agree in 12 cells."""
    d = H.hamming(F.col("phash_a"), F.col("phash_b"))
    cells = H.cells_alike(F.col("grid_a"), F.col("grid_b"))
    marked = pairs.select("*", d.alias("d"), cells.alias("cells"))
    return marked.withColumn("rescue", (F.col("d") > COARSE_D) & (F.col("d") <= RESCUE_D) & (F.col("cells") >= RESCUE_CELLS))


def grid_votes(
    ads: DataFrame, gallery: DataFrame, found: DataFrame, bucket: int | None = VOTE_BUCKET, per_ad: int | None = VOTE_PER_AD, total: int | None = VOTE_TOTAL
) -> DataFrame:
    """For ads without a pair in ``found(ad)``: targets that share at least 12 equal grid cells.

    The limits belong to the result: cells that more than ``bucket`` gallery items share don't vote, and
    ``per_ad`` targets of an ad and ``total`` in all are taken, by votes and then path. None lifts a limit,
    and with all three lifted every pair with 12 equal cells is found.
    """
    cell = lambda df, key: df.select(key, F.posexplode("grid").alias("pos", "cell")).where("cell is not null and cell <> 0")
    left = cell(ads.join(found.select("ad").distinct(), "ad", "left_anti"), "ad")
    right = cell(gallery, "target")
    if bucket is not None:
        right = right.join(right.groupBy("pos", "cell").count().where(F.col("count") <= bucket).select("pos", "cell"), ["pos", "cell"])
    votes = left.join(right, ["pos", "cell"]).where("ad <> target").groupBy("ad", "target").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("ad").orderBy(F.desc("votes"), "target")
    kept = votes.where(F.col("votes") >= RESCUE_CELLS).withColumn("rank", F.row_number().over(order))
    kept = kept if per_ad is None else kept.where(F.col("rank") <= per_ad)
    return kept if total is None else kept.orderBy("ad", "rank").limit(total)


def check_grid(grid: Column) -> Column:
    """A grid that has all its cells, else empty."""
    return F.when(F.size(grid) == GRID_CELLS, grid).otherwise(F.array().cast("array<bigint>"))
