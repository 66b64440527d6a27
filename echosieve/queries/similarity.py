"""Queries of the similarity join: candidates, funnel, groups, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import Gate, Settings, whash_bounds
from ..functions import hashing as H
from ..functions.labels import label
from ..operators import band_join as B
from ..operators import funnel, groups, selection
from ..operators.tables import stored
from ..sources import index
from .tables import ADS, IMAGES, PAIRS, ads, grids, hashes, images, sql_probe, sql_signed_hash, sql_turned, table

LOOSE = Settings(similarity_threshold=75.0, inter_folder_only=False)
STANDARD = Settings()
#: Places by which bits are turned for the three turned variants of an ad.
TURNS = (16, 32, 48)


def _turn(h: Column, k: int) -> Column:
    """A fingerprint's bits turned left by ``k`` places, which stands for a turned picture's fingerprint."""
    return F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k))


def hamming_similarity(spark: SparkSession, d: str) -> DataFrame:
    x = hashes(spark, d)
    y = x.select((F.col("path") - 1).alias("path"), F.col("phash").alias("other"))
    dist = H.hamming(F.col("phash"), F.col("other"))
    sim = H.similarity(dist)
    return x.join(y, "path").select("path", dist.alias("d"), sim.alias("sim"), H.distance_of(sim).alias("back"), label(sim).alias("label"))


def lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return B.with_bands(hashes(spark, d)).select("path", "band", "bucket")


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return B.band_pairs(hashes(spark, d))


def ad_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = B.probe_pairs(ads(spark, d).select(F.col("path").alias("ad"), "phash"), hashes(spark, d).withColumnRenamed("path", "target"))
    return found.withColumn("sim", H.similarity(F.col("d")))


def rotation_max_similarity(spark: SparkSession, d: str) -> DataFrame:
    left = ads(spark, d).select(F.col("path").alias("ad"), "phash", F.array(*(_turn(F.col("phash"), k) for k in TURNS)).alias("turns"))
    return B.rotation_pairs(left, hashes(spark, d).withColumnRenamed("path", "target"))


def band_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents looked up in the index of ads with three turned variants each."""
    known = index.entries(_turned(ads(spark, d)).select("path", "phash", "phash_rot"))
    return index.lookup(known, hashes(spark, d).withColumnRenamed("path", "target"), 19)


def _turned(items: DataFrame) -> DataFrame:
    return items.withColumn("phash_rot", F.create_map(*(x for t, k in zip((90, 180, 270), TURNS, strict=True) for x in (F.lit(t), _turn(F.col("phash"), k)))))


def grid_rescue(spark: SparkSession, d: str) -> DataFrame:
    g = grids(spark, d).select("path", F.struct("phash", "grid").alias("own"))
    near = B.band_pairs(hashes(spark, d).join(g, "path"), own=F.col("own"))
    pairs = near.select("a", "b", *(F.col(f"{s}.{c}").alias(f"{c}_{k}") for s, k in ("xa", "yb") for c in ("phash", "grid")))
    return B.grid_rescues(pairs).select("a", "b", "d", "cells", "rescue")


def grid_vote_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents without a candidate among the others, by the cells that they share with those."""
    left, right = _sides(grids(spark, d), spark, d)
    left, right = left.withColumnRenamed("path", "ad"), right.withColumnRenamed("path", "target")
    found = B.probe_pairs(left.select("ad", "phash"), right.select("target", "phash"))
    return B.grid_votes(left, right, found)


def color_gate_filter(spark: SparkSession, d: str) -> DataFrame:
    return funnel.judged_pairs(images(spark, d), STANDARD, colored=True)


def dual_hash_verdict(spark: SparkSession, d: str) -> DataFrame:
    return funnel.verdict_stage(funnel.candidates(images(spark, d)), LOOSE).select("a", "b", "d", "d_w", "sim")


def mutual_comparison(spark: SparkSession, d: str) -> DataFrame:
    return funnel.mutual_matches(images(spark, d), STANDARD).select("a", "b", "d", "d_w", "sim", label(F.col("sim")).alias("label"))


def _ad_matches(spark: SparkSession, d: str) -> DataFrame:
    known, gallery = _coded(spark, d)
    leaders = known.select("path", (F.col("path") - F.pmod("path", F.lit(40))).alias("leader"))
    return funnel.ad_matches(known, leaders, gallery, LOOSE)


def best_member_per_leader(spark: SparkSession, d: str) -> DataFrame:
    return _ad_matches(spark, d)


def ranked_targets(spark: SparkSession, d: str) -> DataFrame:
    return groups.ranked_members(_ad_matches(spark, d)).select("leader", "item", "rank")


def ad_leader_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.star_groups(hashes(spark, d))


def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    return groups.duplicate_groups(hashes(spark, d), STANDARD.distance)


def _sides(rows: DataFrame, spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    toxic = B.small(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("path")).distinct())
    return rows.join(toxic, "path", "left_semi"), rows.join(toxic, "path", "left_anti")


def _coded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents: those labelled toxic, as pages with codes or as known ads, and all others."""
    return _sides(images(spark, d), spark, d)


def qr_groups(spark: SparkSession, d: str) -> DataFrame:
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    docs = table(spark, d, "documents").join(toxic, "doc_id", "left_semi")
    return groups.qr_groups(stored(H.simhash(docs, "doc_id", "text", phash=1).withColumnRenamed("doc_id", "path")), STANDARD.distance)


def qr_hybrid_first_match(spark: SparkSession, d: str) -> DataFrame:
    return funnel.qr_first_match(*_coded(spark, d), LOOSE)


def ad_like_groups(spark: SparkSession, d: str) -> DataFrame:
    known, items = _coded(spark, d)
    return funnel.ad_like(items, known, LOOSE)


def targeted_best_match(spark: SparkSession, d: str) -> DataFrame:
    return funnel.targeted(ads(spark, d), hashes(spark, d))


def inter_folder_only(spark: SparkSession, d: str) -> DataFrame:
    return funnel.other_folders(funnel.candidates(images(spark, d))).select("a", "b", "d")


def funnel_stats(spark: SparkSession, d: str) -> DataFrame:
    return funnel.counters(images(spark, d), STANDARD)


def select_ad(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_ad(_ad_matches(spark, d), LOOSE)


def _exact(spark: SparkSession, d: str) -> DataFrame:
    x = images(spark, d).select("path", "phash", "folder_path", "size")
    pairs = B.band_pairs(x, 0)
    of = lambda k: x.select(F.col("path").alias(k), F.col("folder_path").alias(f"folder_{k}"), F.col("size").alias(f"size_{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(
        *(F.concat_ws("/", F.col(f"folder_{k}"), F.col(k).cast("string")).alias(k) for k in "ab"), "folder_a", "folder_b", "size_a", "size_b"
    )


def folder_scores(spark: SparkSession, d: str) -> DataFrame:
    return selection.folder_scores(_exact(spark, d))


def select_mutual(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_mutual(_exact(spark, d))


def protected_filter(spark: SparkSession, d: str) -> DataFrame:
    return selection.unprotected(selection.select_mutual(_exact(spark, d)), "src1")


def select_exact(spark: SparkSession, d: str) -> DataFrame:
    found = funnel.mutual_matches(images(spark, d), STANDARD, selection.EXACT)
    return selection.select_exact(found.select(F.col("b").alias("item"), label(F.col("sim")).alias("label")))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item"), F.lit("ad_like").alias("tag"))
    found = funnel.mutual_matches(images(spark, d), Settings(inter_folder_only=False)).select(F.col("a").alias("leader"), F.col("b").alias("item"), "sim")
    return groups.group_keys(found.join(labels, "item", "left"))


def group_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    return selection.display_order(_groups(spark, d))


def qr_summary(spark: SparkSession, d: str) -> DataFrame:
    own = qr_groups(spark, d).groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("found_groups"), F.count_if(F.col("n") > 1).alias("repeated_groups"), F.sum("n").alias("items"))


_Q = (
    hamming_similarity, lsh_buckets, near_duplicate_pairs, ad_match_pairs, rotation_max_similarity, band_index_lookup, grid_rescue, grid_vote_fallback,
    color_gate_filter, dual_hash_verdict, mutual_comparison, best_member_per_leader, ranked_targets, ad_leader_groups, duplicate_components,
    qr_groups, qr_hybrid_first_match, ad_like_groups, targeted_best_match, inter_folder_only, funnel_stats, select_ad, folder_scores,
    select_mutual, protected_filter, select_exact, group_sort_keys, qr_summary,
)
QUERIES = {q.__name__: q for q in _Q}


def _gate(g: Gate, a: str, b: str, rescue: bool = False) -> str:
    dh = f"abs({a}.hue - {b}.hue)"
    return f"""(CASE WHEN greatest({a}.sat, {b}.sat) < {g.low_saturation}::DOUBLE
      THEN abs({a}.val - {b}.val) <= {g.value!r}::DOUBLE AND abs({a}.val * (1.0::DOUBLE - {a}.sat) - {b}.val * (1.0::DOUBLE - {b}.sat)) <= {g.achroma!r}::DOUBLE
        AND abs({a}.sat - {b}.sat) <= {g.low_saturation_step}::DOUBLE
      ELSE least({dh}, 360.0::DOUBLE - {dh}) <= {g.hue!r}::DOUBLE AND abs({a}.sat - {b}.sat) <= {g.saturation!r}::DOUBLE END)"""


_W = "bit_count(xor(x.whash, y.whash))::INTEGER"
_BOUND = f"{whash_bounds()}[d + 1]"


def _verdict(source: str, left: str, right: str, lt: str, rt: str, least: float) -> str:
    """Rows of ``source`` that the wavelet hash accepts, with d_w and sim."""
    return f"""SELECT * FROM (
  SELECT *, CASE WHEN coalesce(d_w <= {_BOUND}, false) THEN 1 - least(d, d_w) / 64.0::DOUBLE ELSE 1 - d / 64.0::DOUBLE END AS sim
  FROM (SELECT p.*, CASE WHEN x.whash <> 0 AND y.whash <> 0 THEN {_W} END AS d_w
        FROM {source} p JOIN {lt} x ON x.path = p.{left} JOIN {rt} y ON y.path = p.{right})
  WHERE coalesce(d_w <= {_BOUND}, false) OR (d_w IS NOT NULL AND d <= 4)) WHERE sim >= {least}"""


_COLORED = f"""colored AS MATERIALIZED (
  SELECT p.* FROM pairs p JOIN images x ON x.path = a JOIN images y ON y.path = b WHERE d <= 4 OR {_gate(STANDARD.gate, "x", "y")})"""


def _mutual(folders: bool) -> str:
    apart = "AND x.folder_path IS DISTINCT FROM y.folder_path" if folders else ""
    return f"""colored AS MATERIALIZED (
  SELECT p.* FROM pairs p JOIN images x ON x.path = a JOIN images y ON y.path = b WHERE (d <= 4 OR {_gate(STANDARD.gate, "x", "y")}) {apart}),
m AS MATERIALIZED ({_verdict("colored", "a", "b", "images", "images", 0.95)})"""


def _label(sim: str) -> str:
    """One decimal, halves to even: similarities are multiples of 1/64, so tenths of percent are exact to tell."""
    t = f"({sim} * 1000)"
    return f"""printf('%.1f%%', (CASE WHEN {t} - floor({t}) = 0.5 AND floor({t})::BIGINT % 2 = 0 THEN floor({t}) ELSE floor({t} + 0.5) END) / 10)"""


_AD_BEST = f"""{IMAGES}, known AS MATERIALIZED (SELECT * FROM images WHERE path IN (SELECT doc_id FROM labels WHERE toxic = 1)),
items AS MATERIALIZED (SELECT * FROM images WHERE path NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {sql_probe("probe", "known", "items")},
probed AS MATERIALIZED (
  SELECT p.* FROM probe p JOIN known x ON x.path = ad JOIN items y ON y.path = target WHERE d <= 4 OR {_gate(LOOSE.gate, "x", "y")}),
judged AS MATERIALIZED ({_verdict("probed", "ad", "target", "known", "items", 0.75)}),
best AS MATERIALIZED (
  SELECT ad - ad % 40 AS leader, target AS item, ad AS member, d AS d_p, d_w, sim, {_label("sim")} AS label
  FROM judged QUALIFY row_number() OVER (PARTITION BY ad - ad % 40, target ORDER BY sim DESC, ad) = 1)"""

_LINKS = """links AS MATERIALIZED (SELECT a, b FROM pairs WHERE d <= 3 UNION SELECT b, a FROM pairs WHERE d <= 3),
reach(x, y) AS (SELECT a, a FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
comp AS MATERIALIZED (SELECT x AS path, min(y) AS leader FROM reach GROUP BY 1)"""

_EXACT = f"""{IMAGES}, {PAIRS},
exact AS MATERIALIZED (
  SELECT concat_ws('/', x.folder_path, a::VARCHAR) AS a, concat_ws('/', y.folder_path, b::VARCHAR) AS b, x.folder_path AS folder_a, y.folder_path AS folder_b,
    x.size AS size_a, y.size AS size_b, length(a::VARCHAR) AS la, length(b::VARCHAR) AS lb
  FROM pairs JOIN images x ON x.path = a JOIN images y ON y.path = b WHERE d = 0),
scores AS MATERIALIZED (
  SELECT folder, sum(p)::BIGINT AS score FROM (
    SELECT folder_a AS folder, (la < lb)::INTEGER + (size_a > size_b)::INTEGER AS p FROM exact WHERE folder_a <> folder_b
    UNION ALL SELECT folder_b, (lb < la)::INTEGER + (size_b > size_a)::INTEGER FROM exact WHERE folder_a <> folder_b) GROUP BY 1),
chosen AS MATERIALIZED (
  SELECT DISTINCT path FROM (
    SELECT CASE WHEN folder_a = folder_b THEN CASE WHEN la > lb THEN a ELSE b END
      WHEN coalesce(s.score, 0) > coalesce(t.score, 0) THEN b WHEN coalesce(t.score, 0) > coalesce(s.score, 0) THEN a END AS path
    FROM exact LEFT JOIN scores s ON s.folder = folder_a LEFT JOIN scores t ON t.folder = folder_b) WHERE path IS NOT NULL)"""

_QR = f"""{IMAGES}, {PAIRS}, coded AS MATERIALIZED (SELECT DISTINCT doc_id AS path FROM labels WHERE toxic = 1),
qpairs AS MATERIALIZED (SELECT a, b FROM pairs WHERE d <= 3 AND a IN (SELECT path FROM coded) AND b IN (SELECT path FROM coded)),
links AS MATERIALIZED (SELECT a, b FROM qpairs UNION SELECT b, a FROM qpairs),
reach(x, y) AS (SELECT path, path FROM images WHERE path IN (SELECT path FROM coded) UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
q AS MATERIALIZED (SELECT x AS path, min(y) AS leader FROM reach GROUP BY 1)"""

_ROTS = ", ".join(sql_turned("h", k) for k in TURNS)
_GRID = f"""grids AS MATERIALIZED (
  SELECT path, {sql_signed_hash("path::VARCHAR")} AS phash,
    CASE WHEN step > 0 THEN list_transform(range(0, 16), lambda i: {sql_signed_hash("substr(text, (i * step + 1)::BIGINT, step)")}) ELSE [] END AS grid
  FROM (SELECT doc_id AS path, text, length(text) // 16 AS step FROM documents))"""

SQL = {
    "hamming_similarity": f"""WITH {IMAGES} SELECT x.path, bit_count(xor(x.phash, y.phash))::INTEGER AS d, 1 - bit_count(xor(x.phash, y.phash)) / 64.0::DOUBLE AS sim,
  bit_count(xor(x.phash, y.phash))::INTEGER AS back, {_label("(1 - bit_count(xor(x.phash, y.phash)) / 64.0::DOUBLE)")} AS label FROM images x JOIN images y ON y.path = x.path + 1""",
    "lsh_buckets": f"""WITH {IMAGES} SELECT path, i AS band, ((phash >> (8 * i)) & 255)::INTEGER AS bucket FROM images, (SELECT unnest(range(0, 8))::INTEGER AS i) WHERE phash <> 0""",
    "near_duplicate_pairs": f"WITH {IMAGES}, {PAIRS} SELECT a, b, d FROM pairs",
    "ad_match_pairs": f"""WITH {IMAGES}, {ADS}, {sql_probe("probe", "ads", "images")} SELECT ad, target, d, 1 - d / 64.0::DOUBLE AS sim FROM probe""",
    "rotation_max_similarity": f"""WITH {IMAGES}, {ADS}, {sql_probe("probe", "ads", "images", 64)},
turned AS (SELECT path, phash AS h, [{_ROTS}] AS turns FROM (SELECT path, phash, phash AS h FROM ads))
SELECT * FROM (SELECT p.ad, p.target, p.d AS d0, least(p.d, list_min(list_transform(t.turns, lambda z: bit_count(xor(CASE WHEN z <> 0 THEN z ELSE t.h END, y.phash))))::INTEGER) AS d
FROM probe p JOIN turned t ON t.path = p.ad JOIN images y ON y.path = p.target) WHERE d <= 19""",
    "band_index_lookup": f"""WITH {IMAGES}, {ADS}, v AS MATERIALIZED (SELECT path, unnest([h, {_ROTS}]) AS phash FROM (SELECT path, phash AS h FROM ads))
SELECT y.path AS target, x.path, min(bit_count(xor(x.phash, y.phash)))::INTEGER AS d FROM v x JOIN images y ON x.phash <> 0 AND y.phash <> 0 AND bit_count(xor(x.phash, y.phash)) <= 19
  AND len(list_filter(range(0, 8), lambda i: (xor(x.phash, y.phash) >> (8 * i)) & 255 = 0)) > 0 GROUP BY 1, 2""",
    "grid_rescue": f"""WITH {IMAGES}, {PAIRS}, {_GRID},
c AS (SELECT a, b, bit_count(xor(x.phash, y.phash))::INTEGER AS d,
    len(list_filter(list_zip(x.grid, y.grid), lambda z: z[1] <> 0 AND z[2] <> 0 AND bit_count(xor(z[1], z[2])) <= 3))::INTEGER AS cells
  FROM pairs p JOIN grids x ON x.path = a JOIN grids y ON y.path = b)
SELECT a, b, d, cells, d > 19 AND d <= 38 AND cells >= 12 AS rescue FROM c""",
    "grid_vote_fallback": f"""WITH {_GRID}, l AS MATERIALIZED (SELECT path, phash, grid FROM grids WHERE path IN (SELECT doc_id FROM labels WHERE toxic = 1)), r AS MATERIALIZED (SELECT path, phash, grid FROM grids WHERE path NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
{sql_probe("probe", "(SELECT path, phash FROM l)", "(SELECT path, phash FROM r)")},
lc AS (SELECT path AS ad, i, grid[i] AS c FROM l, (SELECT unnest(range(1, 17)) AS i) WHERE path NOT IN (SELECT ad FROM probe)),
rc AS (SELECT path AS target, i, grid[i] AS c FROM r, (SELECT unnest(range(1, 17)) AS i)),
ok AS (SELECT i, c FROM rc WHERE c <> 0 GROUP BY 1, 2 HAVING count(*) <= 1000),
v AS (SELECT ad, target, count(*) AS votes FROM lc JOIN rc USING (i, c) JOIN ok USING (i, c) GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT ad, target, votes, (row_number() OVER (PARTITION BY ad ORDER BY votes DESC, target))::INTEGER AS rank FROM v QUALIFY rank <= 200 ORDER BY ad, rank LIMIT 5000""",
    "color_gate_filter": f"WITH {IMAGES}, {PAIRS}, {_COLORED} SELECT a, b, d FROM colored",
    "dual_hash_verdict": f"""WITH {IMAGES}, {PAIRS}, m AS ({_verdict("pairs", "a", "b", "images", "images", 0.75)}) SELECT a, b, d, d_w, sim FROM m""",
    "mutual_comparison": f"WITH {IMAGES}, {PAIRS}, {_mutual(True)} SELECT a, b, d, d_w, sim, {_label('sim')} AS label FROM m",
    "best_member_per_leader": f"WITH {_AD_BEST} SELECT * FROM best",
    "ranked_targets": f"WITH {_AD_BEST} SELECT leader, item, (row_number() OVER (PARTITION BY leader ORDER BY sim DESC, item))::INTEGER AS rank FROM best",
    "ad_leader_groups": f"""WITH RECURSIVE {IMAGES}, o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY path) AS n, path, phash FROM images),
walk(n, path, leader, leaders) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::STRUCT(p BIGINT, h BIGINT)[]
  UNION ALL SELECT n, path, coalesce(hit, path), CASE WHEN hit IS NULL AND phash <> 0 THEN list_append(leaders, {{'p': path, 'h': phash}}) ELSE leaders END FROM (
    SELECT o.n, o.path, o.phash, w.leaders, CASE WHEN o.phash <> 0 THEN list_filter(w.leaders, lambda z: bit_count(xor(z.h, o.phash)) <= 3)[1].p END AS hit
    FROM walk w JOIN o ON o.n = w.n + 1))
SELECT path, leader FROM walk WHERE n > 0""",
    "duplicate_components": f"WITH RECURSIVE {IMAGES}, {PAIRS}, {_LINKS} SELECT leader, path FROM comp",
    "qr_groups": f"WITH RECURSIVE {_QR} SELECT leader, path, count(*) OVER (PARTITION BY leader) AS n FROM q",
    "qr_hybrid_first_match": f"""WITH {IMAGES}, pages AS MATERIALIZED (SELECT * FROM images WHERE path IN (SELECT doc_id FROM labels WHERE toxic = 1)),
known AS MATERIALIZED (SELECT * FROM images WHERE path NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {sql_probe("probe", "known", "pages")},
j AS (SELECT ad, target, d, CASE WHEN x.whash <> 0 AND y.whash <> 0 THEN {_W} END AS d_w FROM probe JOIN known x ON x.path = ad JOIN pages y ON y.path = target),
k AS (SELECT *, CASE WHEN d > 4 AND coalesce(d_w <= {_BOUND}, false) THEN 1 - least(d, d_w) / 64.0::DOUBLE ELSE 1 - d / 64.0::DOUBLE END AS sim FROM j WHERE d <= 4 OR coalesce(d_w <= {_BOUND}, false))
SELECT target AS page, min(ad) AS ad, arg_min(sim, ad) AS sim FROM k WHERE sim >= 0.75 GROUP BY 1""",
    "ad_like_groups": f"""WITH {IMAGES}, items AS MATERIALIZED (SELECT * FROM images WHERE path NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
known AS MATERIALIZED (SELECT * FROM images WHERE path IN (SELECT doc_id FROM labels WHERE toxic = 1)),
probe AS MATERIALIZED (SELECT x.path AS ad, y.path AS target, bit_count(xor(x.phash, y.phash))::INTEGER AS d
  FROM known x JOIN items y ON x.phash <> 0 AND y.phash <> 0 AND bit_count(xor(x.phash, y.phash)) <= 19),
j AS (SELECT target, d, CASE WHEN x.whash <> 0 AND y.whash <> 0 THEN {_W} END AS d_w FROM probe JOIN known x ON x.path = ad JOIN items y ON y.path = target WHERE d <= 4 OR {_gate(LOOSE.gate, "x", "y")})
SELECT DISTINCT target AS path FROM j WHERE coalesce(d_w <= {_BOUND}, false) OR (d_w IS NULL AND d <= 4)""",
    "targeted_best_match": f"""WITH {IMAGES}, {ADS}, j AS (SELECT x.path AS leader, y.path AS item, bit_count(xor(x.phash, y.phash))::INTEGER AS d_p
  FROM ads x JOIN images y ON x.phash <> 0 AND y.phash <> 0 AND bit_count(xor(x.phash, y.phash)) <= 38 AND y.path NOT IN (SELECT path FROM ads))
SELECT leader, item, d_p, 1 - d_p / 64.0::DOUBLE AS sim FROM j QUALIFY row_number() OVER (PARTITION BY leader ORDER BY d_p, item) = 1""",
    "inter_folder_only": f"WITH {IMAGES}, {PAIRS} SELECT a, b, d FROM pairs JOIN images x ON x.path = a JOIN images y ON y.path = b WHERE x.folder_path IS DISTINCT FROM y.folder_path",
    "funnel_stats": f"""WITH {IMAGES}, {PAIRS}, {_mutual(True)} SELECT (SELECT count(*) FROM pairs) AS passed_phash,
  (SELECT count(*) FROM pairs JOIN images x ON x.path = a JOIN images y ON y.path = b WHERE x.folder_path IS DISTINCT FROM y.folder_path) AS passed_folder,
  (SELECT count(*) FROM pairs JOIN images x ON x.path = a JOIN images y ON y.path = b WHERE x.folder_path IS NOT DISTINCT FROM y.folder_path) AS filtered_inter,
  (SELECT count(*) FROM colored) AS passed_color, (SELECT count(*) FROM colored JOIN images x ON x.path = a JOIN images y ON y.path = b WHERE x.whash <> 0 AND y.whash <> 0) AS entered_whash,
  (SELECT count(*) FROM m) AS accepted""",
    "select_ad": f"WITH {_AD_BEST} SELECT DISTINCT item AS path FROM best WHERE rtrim(label, '%')::DOUBLE >= 87.5",
    "folder_scores": f"WITH {_EXACT} SELECT folder, score FROM scores",
    "select_mutual": f"WITH {_EXACT} SELECT path FROM chosen",
    "protected_filter": f"WITH {_EXACT} SELECT path FROM chosen WHERE NOT starts_with(path, 'src1/')",
    "select_exact": f"WITH {IMAGES}, {PAIRS}, {_mutual(True)} SELECT DISTINCT b AS path FROM m WHERE {_label('sim')} = '100.0%'",
    "group_sort_keys": f"""WITH {IMAGES}, {PAIRS}, {_mutual(False)},
k AS (SELECT a AS leader, count(*) + 1 AS n, max(sim) AS best, bool_or(b IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS ad_like FROM m GROUP BY 1)
SELECT leader, n, best, ad_like, (row_number() OVER (ORDER BY ad_like DESC, best DESC, leader))::INTEGER AS place FROM k""",
    "qr_summary": f"""WITH RECURSIVE {_QR}, s AS (SELECT leader, count(*) AS n FROM q GROUP BY 1)
SELECT count(*) AS found_groups, count(*) FILTER (n > 1) AS repeated_groups, sum(n)::BIGINT AS items FROM s""",
}
