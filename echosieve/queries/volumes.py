"""Queries of volume deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles as T
from ..operators import selection, volume
from ..plans.modes import LAST_PAGES
from .tables import IMAGES, hashes, table


#: Names that a task reads, where a table has fewer parts than there are cores.
NAMES_A_TASK = 1 << 15


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in few parts, dealt to more tasks: names are few bytes and much work."""
    if rows.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    tasks = -(-rows.count() // NAMES_A_TASK)
    return rows.repartition(tasks) if tasks > 1 else rows


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Parts as volume folders with bracketed tags, a volume label or a last number."""
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" Vol. "), F.col("p_size"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" #"), F.col("p_size"))).otherwise(F.lit(" - uncensored"))
    name = F.concat(F.lit("["), F.col("p_brand"), F.lit("] "), F.col("p_type"), F.lit("_"), F.col("p_name"), label, F.when(F.col("p_partkey") % 5 == 0, " (ongoing)").otherwise(""))
    return _spread(table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name")).select(F.col("p_partkey").alias("path"), name.alias("name"))


def skeleton_extract(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("path", T.skeleton(F.col("name")).alias("skeleton"), T.volume_number(F.col("name")).alias("vol_num"))


def volume_intra_pairs(spark: SparkSession, d: str) -> DataFrame:
    return volume.intra_pairs(skeleton_extract(spark, d))


def volume_scores(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("path", T.volume_score(F.col("name")).alias("score"), T.is_uncensored(F.col("name")).alias("uncensored"))


def select_volume(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    pairs = volume.intra_pairs(skeleton_extract(spark, d))
    named = pairs.join(names.select(F.col("path").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("path").alias("b"), F.col("name").alias("nb")), "b")
    return selection.select_volume(named.select(F.concat_ws("/", F.col("a").cast("string"), F.col("na")).alias("a"), F.concat_ws("/", F.col("b").cast("string"), F.col("nb")).alias("b")))


def _pages(spark: SparkSession, d: str, last: int | None = None) -> DataFrame:
    of = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("folder"))
    pages = hashes(spark, d).join(of, "path").select("folder", "path", "phash", F.col("path").alias("ord"))
    known = pages.where("path % 10 = 0").select("phash")
    return volume.sample_pages(pages, known, last)


def volume_sample(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, LAST_PAGES).select("folder", "path", "rank")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("path")).distinct().withColumn("skeleton", F.regexp_replace("path", "[0-9]$", ""))


def volume_cross_name(spark: SparkSession, d: str) -> DataFrame:
    return volume.cross_pairs(_pages(spark, d), _sources(spark, d))


def volume_match_ratio(spark: SparkSession, d: str) -> DataFrame:
    return volume.matched_pages(volume_cross_name(spark, d), _pages(spark, d, LAST_PAGES), 3)


def series_components(spark: SparkSession, d: str) -> DataFrame:
    f = _sources(spark, d)
    return volume.series(f, volume.cross_pairs(_pages(spark, d), f))


def series_rows(spark: SparkSession, d: str) -> DataFrame:
    return volume.series_rows(_sources(spark, d), series_components(spark, d))


_Q = (
    skeleton_extract, volume_intra_pairs, volume_scores, select_volume, volume_sample, volume_cross_name, volume_match_ratio,
    series_components, series_rows,
)
QUERIES = {q.__name__: q for q in _Q}

_NAMES = r"""names AS MATERIALIZED (SELECT p_partkey AS path, '[' || p_brand || '] ' || p_type || '_' || p_name
    || CASE p_partkey % 3 WHEN 0 THEN ' Vol. ' || p_size::VARCHAR WHEN 1 THEN ' #' || p_size::VARCHAR ELSE ' - uncensored' END
    || CASE WHEN p_partkey % 5 = 0 THEN ' (ongoing)' ELSE '' END AS name FROM part),
bare AS MATERIALIZED (SELECT path, name, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\[.*?\]|\(.*?\)', ' ', 'g'),
    '(?i)(vol|ch|chapter|ep|page|book|v)\.?\s*\d+', ' ', 'g'), '\s+#?\d+\s*$', ' '), '[-_\s.]+', ' ', 'g'))) AS b,
    nullif(regexp_extract(name, '(?i)(?:vol|v|ch)\.?\s*(\d+)', 1), '')::INTEGER AS vol_num FROM names),
skel AS MATERIALIZED (SELECT path, name, vol_num, CASE WHEN length(b) >= 2 THEN b ELSE lower(trim(name)) END AS skeleton FROM bare)"""
_SCORE = "(CASE WHEN contains(lower({n}), 'ongoing') THEN -500 ELSE 0 END + CASE WHEN contains(lower({n}), 'uncensored') THEN 100 ELSE 0 END)"
_SAMPLE = """pages AS MATERIALIZED (SELECT path, folder_path AS folder, phash FROM images WHERE phash <> 0 AND phash NOT IN (SELECT phash FROM images WHERE path % 10 = 0)),
sample AS MATERIALIZED (SELECT folder, path, phash, (row_number() OVER (PARTITION BY folder ORDER BY path DESC))::INTEGER AS rank FROM pages)"""
_CROSS = """sources AS MATERIALIZED (SELECT DISTINCT source AS path, regexp_replace(source, '[0-9]$', '') AS skeleton FROM documents),
crossed AS MATERIALIZED (SELECT DISTINCT x.folder AS a, y.folder AS b, u.skeleton AS sa, v.skeleton AS sb FROM sample x JOIN sample y ON x.phash >> 8 = y.phash >> 8 AND x.folder < y.folder
  JOIN sources u ON u.path = x.folder JOIN sources v ON v.path = y.folder WHERE u.skeleton <> v.skeleton)"""
_SERIES = """l AS MATERIALIZED (SELECT sa AS x, sb AS y FROM crossed UNION SELECT sb, sa FROM crossed),
reach(x, y) AS (SELECT DISTINCT skeleton, skeleton FROM sources UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
series AS MATERIALIZED (SELECT x AS skeleton, arg_min(y, (length(y), y)) AS series FROM reach GROUP BY 1)"""

SQL = {
    "skeleton_extract": f"WITH {_NAMES} SELECT path, skeleton, vol_num FROM skel",
    "volume_intra_pairs": f"WITH {_NAMES} SELECT x.path AS a, y.path AS b, x.skeleton FROM skel x JOIN skel y ON x.skeleton = y.skeleton AND x.path < y.path",
    "volume_scores": f"WITH {_NAMES} SELECT path, {_SCORE.format(n='name')} AS score, contains(lower(name), 'uncensored') AS uncensored FROM names",
    "select_volume": f"""WITH {_NAMES}, p AS (SELECT x.path::VARCHAR || '/' || x.name AS a, y.path::VARCHAR || '/' || y.name AS b, {_SCORE.format(n="x.name")} AS sa, {_SCORE.format(n="y.name")} AS sb
  FROM skel x JOIN skel y ON x.skeleton = y.skeleton AND x.path < y.path)
SELECT DISTINCT CASE WHEN sa > sb THEN b ELSE a END AS path FROM p WHERE sa <> sb""",
    "volume_sample": f"WITH {IMAGES}, {_SAMPLE} SELECT folder, path, rank FROM sample WHERE rank <= 12",
    "volume_cross_name": f"WITH {IMAGES}, {_SAMPLE}, {_CROSS} SELECT DISTINCT a, b FROM crossed",
    "volume_match_ratio": f"""WITH RECURSIVE {IMAGES}, {_SAMPLE}, {_CROSS},
hs AS MATERIALIZED (SELECT folder, list(phash ORDER BY rank) AS h FROM sample WHERE rank <= 12 GROUP BY 1),
p AS MATERIALIZED (SELECT a, b, x.h AS ha, y.h AS hb FROM (SELECT DISTINCT a, b FROM crossed) JOIN hs x ON x.folder = a JOIN hs y ON y.folder = b),
w(a, b, i, used) AS (
  SELECT a, b, 0::BIGINT, []::BIGINT[] FROM p
  UNION ALL SELECT a, b, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (
    SELECT w.*, list_filter(range(1, len(hb) + 1), lambda j: NOT list_contains(used, j) AND bit_count(xor(hb[j], ha[i + 1])) <= 3)[1] AS hit
    FROM w JOIN p USING (a, b) WHERE i < len(ha)))
SELECT a, b, len(used)::INTEGER AS matched, len(used) * 100.0::DOUBLE / least(len(ha), len(hb)) AS ratio FROM w JOIN p USING (a, b) WHERE i = len(ha)""",
    "series_components": f"WITH RECURSIVE {IMAGES}, {_SAMPLE}, {_CROSS}, {_SERIES} SELECT skeleton, series FROM series",
    "series_rows": f"""WITH RECURSIVE {IMAGES}, {_SAMPLE}, {_CROSS}, {_SERIES}, r AS (SELECT series, path, count(*) OVER (PARTITION BY series) AS volumes FROM sources JOIN series USING (skeleton))
SELECT * FROM r WHERE volumes >= 2""",
}
