"""The comparison funnel: coarse candidates, colour, wavelet verdict, best member, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import COARSE_D, HASH_BITS, RESCUE_CELLS, RESCUE_D, RESCUED, STRICT_D, TARGET_FLOOR, Settings, most_distance
from ..functions import color
from ..functions import hashing as H
from ..functions.labels import label
from . import blocks
from .band_join import BANDED, BROADCAST_ROWS, alike_pairs, band_pairs, check_grid, grid_votes, probe_pairs, small


#: What pairs are judged by, and what turns and grids add to it where features have them.
_COMPARED = ("folder_path", "hsv", "whash")
_TURNED = ("phash", "phash_rot", "grid", "grid_rot")
TURNS = (90, 180, 270)


def _own(items: DataFrame, columns: tuple[str, ...] = _COMPARED) -> Column:
    """What the stages compare of a row, as a struct.

    Missing values are filled in here, once a row: where nothing can be null, the code that judges pairs stays
    below the size that the JVM compiles (8,000 bytes a method). ``known`` tells of a colour.
    """
    zero, filled = F.lit(0.0), {"whash": F.coalesce("whash", F.lit(0).cast("bigint"))}
    own = [filled.get(c, F.col(c)).alias(c) for c in columns if c in items.columns and c != "hsv"]
    if "hsv" in items.columns:
        hsv = F.struct(*(F.coalesce(F.col("hsv")[c].cast("double"), zero).alias(c) for c in "hsv"))
        own += [hsv.alias("hsv"), F.col("hsv").isNotNull().alias("known")]
    return F.struct(*own)


def candidates(items: DataFrame, most: int = COARSE_D, columns: tuple[str, ...] = _COMPARED) -> DataFrame:
    """Attributed pairs of items that share a byte, within ``most`` bits; rows carry what is compared into the join."""
    return band_pairs(items, most, own=_own(items, columns))


def _parts(items: DataFrame) -> int:
    """Parts for rows that are few but much work; parts dealt by number aren't merged."""
    return int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _has_turns(items: DataFrame) -> bool:
    return "phash_rot" in items.columns or "grid" in items.columns


def _nearest(left: DataFrame, right: DataFrame) -> Column:
    """The least distance over the turns of ``x``; a turn that is missing or zero counts as upright."""
    x, y = F.col("x.phash"), F.col("y.phash")
    turns = [F.element_at("x.phash_rot", F.lit(t)) for t in TURNS] if "phash_rot" in left.columns else []
    return F.least(H.hamming(x, y), *(H.hamming(F.when(H.valid(t), t).otherwise(x), y) for t in turns), F.lit(HASH_BITS))


def _cells(left: DataFrame, right: DataFrame) -> Column:
    """The most grid cells that agree over the turns of ``x``."""
    if "grid" not in left.columns or "grid" not in right.columns:
        return F.lit(0)
    grids = [F.col("x.grid"), *(F.element_at("x.grid_rot", F.lit(t)) for t in TURNS if "grid_rot" in left.columns)]
    return F.greatest(F.lit(0), *(H.cells_alike(check_grid(g), check_grid(F.col("y.grid"))) for g in grids))


def _within_reach(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Attributed candidates whose nearest turn is within the coarse distance or whose grids rescue them."""
    near = pairs.withColumn("d", _nearest(left, right))
    rescue = (F.col("d") > COARSE_D) & (F.col("d") <= RESCUE_D) & (_cells(left, right) >= RESCUE_CELLS)
    return near.withColumn("rescue", rescue).where((F.col("d") <= COARSE_D) | F.col("rescue"))


def _rescue(pairs: DataFrame) -> Column:
    return F.col("rescue") if "rescue" in pairs.columns else F.lit(False)


def _whash_distance() -> Column:
    """The distance of the wavelet hashes of both sides; null where either is invalid."""
    x, y = F.col("x.whash"), F.col("y.whash")
    return F.when(H.valid(x) & H.valid(y), H.hamming(x, y))


def color_stage(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Attributed pairs with ``d`` (and ``rescue``) whose colours agree."""
    if not settings.use_color_filter:
        return pairs
    return pairs.where(color.passes(F.col("x.hsv"), F.col("y.hsv"), F.col("d"), _rescue(pairs), settings.gate))


def verdict_stage(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Attributed pairs that the wavelet hash accepts, with ``d_w`` and the final ``sim`` over the threshold."""
    rescue = _rescue(pairs)
    judged = pairs.withColumn("d_w", _whash_distance())
    if settings.use_whash:
        accept, final = H.accepted(F.col("d"), F.col("d_w"), rescue), H.final_similarity(F.col("d"), F.col("d_w"), rescue)
    else:
        accept = rescue | (F.col("d") <= settings.distance)
        final = F.when(rescue, F.greatest(H.similarity(F.col("d")), F.lit(RESCUED))).otherwise(H.similarity(F.col("d")))
    return judged.withColumn("sim", final).where(accept & (F.col("sim") >= settings.similarity))


def other_folders(pairs: DataFrame) -> DataFrame:
    """Attributed pairs whose items lie in different folders."""
    return pairs.where(~F.col("x.folder_path").eqNullSafe(F.col("y.folder_path")))


def judged_pairs(images: DataFrame, settings: Settings, apart: bool = False, colored: bool = False, least: float | None = None) -> DataFrame:
    """Candidates up to the coarse distance that pass the stages named: (a, b, d) and, after a verdict, (d_w, sim).

    ``least`` is the similarity that the wavelet verdict asks for. Pairs are judged as arrays, block against block.
    """
    return blocks.pairs(images, blocks.Rule(COARSE_D, apart, settings.gate if colored and settings.use_color_filter else None, least))


def mutual_matches(images: DataFrame, settings: Settings, least: float = 0.0) -> DataFrame:
    """The gallery against itself: accepted pairs (a, b, d, d_w, sim), those of similarity ``least`` at least.

    Where ``images`` has turns or grids, candidates share a byte upright and are judged by ``a``'s nearest
    turn or rescued by the grids; a column ``rescue`` then tells which.
    """
    most = min(settings.distance, most_distance(least))
    if _has_turns(images):
        pairs = _within_reach(candidates(images, HASH_BITS, _COMPARED + _TURNED), images, images)
    elif most <= BANDED:
        # Either hash must reach the threshold, so the pairs to judge are few.
        pairs = alike_pairs(images, most, _own(images)) if settings.use_whash else candidates(images, most)
    elif settings.use_whash:
        return judged_pairs(images, settings, settings.inter_folder_only, True, max(settings.similarity, least))
    else:
        pairs = candidates(images)
    if settings.inter_folder_only:
        pairs = other_folders(pairs)
    return verdict_stage(color_stage(pairs, settings), settings).where(F.col("sim") >= least).drop("x", "y")


def ad_matches(ads: DataFrame, leaders: DataFrame, gallery: DataFrame, settings: Settings) -> DataFrame:
    """Known ads against the gallery: for each (leader, item) its best member.

    ``ads`` and ``gallery`` have path, phash, whash, hsv; ``leaders`` maps each ad's path to its leader.
    Every member is compared; of equal similarities the first member in path order counts. Where ``ads``
    has turns or grids, pairs are judged by the nearest turn or rescued by the grids, and ads that share no
    byte with any item get the items that their grid cells vote for.
    """
    columns = _COMPARED + _TURNED if _has_turns(ads) else _COMPARED
    led = ads.join(small(leaders.select("path", F.col("leader").alias("_leader"))), "path")
    left = led.select(F.col("path").alias("ad"), "phash", _own(ads, columns).withField("leader", F.col("_leader")).alias("x"))
    # Dealt by their own names once, items keep all their pairs in one place until the best are found.
    right = gallery.repartition(_parts(gallery), "path").select(F.col("path").alias("target"), "phash", _own(gallery, columns).alias("y"))
    if "phash_rot" in ads.columns and "grid" not in ads.columns and settings.use_whash:
        turned = {f"turn{t}": F.coalesce(F.nullif(F.element_at("phash_rot", F.lit(t)), F.lit(0).cast("bigint")), F.col("phash")) for t in TURNS}
        rule = blocks.Rule(COARSE_D, False, settings.gate if settings.use_color_filter else None, settings.similarity)
        best = blocks.best_members(led.withColumnRenamed("_leader", "leader").withColumns(turned), gallery, rule, tuple(turned))
        return best.withColumn("label", label(F.col("sim")))
    if _has_turns(ads):
        pairs = probe_pairs(left, right, HASH_BITS)
        if "grid" in ads.columns and "grid" in gallery.columns:
            cells = lambda t, key: t.where(H.valid(F.col("phash"))).select(F.col("path").alias(key), check_grid(F.col("grid")).alias("grid"))
            votes = grid_votes(cells(ads, "ad"), cells(gallery, "target"), pairs.select("ad")).select("ad", "target", F.lit(0).alias("d"))
            votes = votes.join(small(left.select("ad", "x")), "ad").join(right.select("target", "y"), "target")
            pairs = pairs.unionByName(votes)
        pairs = _within_reach(pairs.where("ad <> target"), ads, gallery)
    else:
        pairs = probe_pairs(left, right).where("ad <> target")
    kept = verdict_stage(color_stage(pairs, settings), settings)
    best = kept.groupBy("x.leader", F.col("target").alias("item")).agg(F.min(F.struct((-F.col("sim")).alias("less"), "ad", "d", "d_w")).alias("m"))
    best = best.select("leader", "item", F.col("m.ad").alias("member"), F.col("m.d").alias("d_p"), F.col("m.d_w").alias("d_w"), (-F.col("m.less")).alias("sim"))
    return best.withColumn("label", label(F.col("sim")))


def ad_like(items: DataFrame, ads: DataFrame, settings: Settings) -> DataFrame:
    """Items that some ad accepts: by colour, then by the wavelet hash, whatever the user's threshold.

    Each item is compared with every ad, not only with those that share a byte. Strict matches with a
    missing wavelet hash count here. Where ``ads`` has turns or grids, the nearest turn counts, and grids
    that agree rescue at any distance. Returns the items' paths.
    """
    turned = _has_turns(ads)
    columns = _COMPARED + _TURNED if turned else _COMPARED
    left = ads.where(H.valid(F.col("phash"))).select(F.col("path").alias("ad"), F.col("phash").alias("h"), _own(ads, columns).alias("x"))
    right = items.where(H.valid(F.col("phash"))).select("path", "phash", _own(items, columns).alias("y"))
    d = _nearest(ads, items) if turned else H.hamming(F.col("h"), F.col("phash"))
    rescue, d_w = _cells(ads, items) >= RESCUE_CELLS if turned and "grid" in ads.columns else F.lit(False), _whash_distance()
    near = (d <= COARSE_D) | rescue
    if settings.use_color_filter:
        near = near & color.passes(F.col("x.hsv"), F.col("y.hsv"), d, rescue, settings.gate) & ((d <= STRICT_D) | F.col("x.known") & F.col("y.known"))
    alike = H.passes_whash(d, d_w) | (d_w.isNull() & (d <= STRICT_D)) if settings.use_whash else d <= settings.distance
    blocks = -(-left.count() // BROADCAST_ROWS) or 1
    # An item needs one ad that accepts it, so no pair leaves the join.
    parts = (left.where(F.pmod(F.xxhash64("ad"), F.lit(blocks)) == i) for i in range(blocks))
    return reduce(DataFrame.unionByName, (right.join(F.broadcast(p), near & (rescue | alike), "left_semi").select("path") for p in parts)).distinct()


def targeted(ads: DataFrame, gallery: DataFrame) -> DataFrame:
    """The nearest gallery item of each ad over a similarity of 0.40, whatever the user's threshold.

    Items that are ads themselves don't count; of equal distances the first path wins. All pairs are
    compared, as the floor lies below any band's reach, so the stated ads meet the gallery in blocks of a
    size that a broadcast may hold.
    """
    most = most_distance(TARGET_FLOOR + 1e-6)
    left = ads.where(H.valid(F.col("phash"))).select(F.col("path").alias("ad"), F.col("phash").alias("h"))
    rest = gallery.where(H.valid(F.col("phash"))).join(small(left), gallery.path == left.ad, "left_anti")
    blocks = -(-left.count() // BROADCAST_ROWS) or 1
    d = H.hamming(F.col("h"), F.col("phash"))
    tops = []
    for i in range(blocks):
        block = left.where(F.pmod(F.xxhash64("ad"), F.lit(blocks)) == i)
        near = rest.join(F.broadcast(block), d <= most).select("ad", F.struct(d.alias("d"), "path").alias("m"))
        tops.append(near.groupBy("ad").agg(F.min("m").alias("m")))
    best = reduce(DataFrame.unionByName, tops)
    return best.select(F.col("ad").alias("leader"), F.col("m.path").alias("item"), F.col("m.d").alias("d_p"), H.similarity(F.col("m.d")).alias("sim"))


def qr_first_match(pages: DataFrame, ads: DataFrame, settings: Settings) -> DataFrame:
    """For each page with a code the first ad with a code that accepts it: (page, ad, sim)."""
    left, right = (t.select(F.col("path").alias(key), "phash", _own(t).alias(to)) for t, key, to in ((ads, "ad", "x"), (pages, "target", "y")))
    pairs = probe_pairs(left, right).withColumn("d_w", _whash_distance())
    passes, strict = H.passes_whash(F.col("d"), F.col("d_w")), F.col("d") <= STRICT_D
    final = F.when(~strict & passes, H.similarity(F.least("d", "d_w"))).otherwise(H.similarity(F.col("d")))
    kept = pairs.withColumn("sim", final).where((strict | passes) & (F.col("sim") >= settings.similarity))
    return kept.groupBy(F.col("target").alias("page")).agg(F.min(F.struct("ad", "sim")).alias("m")).select("page", F.col("m.ad").alias("ad"), F.col("m.sim").alias("sim"))


def counters(images: DataFrame, settings: Settings) -> DataFrame:
    """How many pairs each stage of the mutual funnel keeps, as one row from one pass over the pairs."""
    rule = blocks.Rule(COARSE_D, settings.inter_folder_only, settings.gate if settings.use_color_filter else None, settings.similarity)
    return blocks.counts(images, rule, settings.use_whash)
