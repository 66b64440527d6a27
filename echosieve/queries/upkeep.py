"""Queries of upkeep: backfills, quarantine, hints, digests of a catalogue, orders, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles as T
from ..operators import diff, selection, sync, tail, upkeep
from ..operators.tables import stored
from .catalogue import _CAT, _catalogue
from .tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the web as files, every third in an archive and every fifth without a stored folder."""
    plain = F.regexp_replace(F.regexp_extract("url", "^([^?#]*)", 1), "^[a-z]+://", "")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("zip://"), plain, F.lit(".cbz!a/"), F.col("page_id"), F.lit(".png"))).otherwise(F.concat(plain, F.lit("/"), F.col("page_id"), F.lit(".png")))
    folder = F.when(F.col("page_id") % 5 == 0, F.lit("")).when(F.col("page_id") % 7 == 0, F.lit(None)).otherwise(F.lit("known"))
    return table(spark, d, "pages").select("page_id", path.alias("path"), folder.alias("folder_path"))


def folder_backfill(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.backfilled(_pages(spark, d)).select("page_id", "folder_path")


def folder_missing(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.without_folder(_pages(spark, d))


def quarantine_union(spark: SparkSession, d: str) -> DataFrame:
    """What was in quarantine, and events that failed, under spellings of their paths."""
    e = table(spark, d, "events")
    name = lambda sign: F.concat(F.lit(sign), "user_id")
    known = e.where("event_type = 'signup'").select(name("/q/").alias("path"))
    return upkeep.quarantined(known, e.where("event_type = 'error'").select(name("file:///Q//").alias("path")))


def first_scan_tails(spark: SparkSession, d: str) -> DataFrame:
    """The last 2 pages of a conversation, or 4 of one that is new."""
    pages = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("p"), F.col("turn"), F.lit(".jpg")).alias("name"))
    return tail.last_pages(pages, "conv_id", "name", tail.page_limit(2, 4, F.col("conv_id") % 3 == 0)).select("conv_id", "name", "rank")


def rescan_tails(spark: SparkSession, d: str) -> DataFrame:
    """The last pages of folders of which a cached page is gone."""
    e = table(spark, d, "events")
    tasks = e.select(F.col("event_id").alias("path"))
    now = e.where("event_id % 11 <> 0").select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"), F.lit("q").alias("qd64"))
    was = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"), F.lit("q").alias("qd64"), F.lit(1).alias("features_at"))
    gone = diff.cache_plan(tasks, now, was, 1).where("plan = 'purge'").select("path")
    folders = e.join(gone, F.col("event_id") == F.col("path"), "left_semi").select("user_id").distinct()
    pages = now.join(e.select(F.col("event_id").alias("path"), "user_id"), "path").join(folders, "user_id", "left_semi")
    return tail.last_by(pages, "user_id", [F.desc("path")], 3).select("user_id", "path", "rank")


def feature_upgrade(spark: SparkSession, d: str) -> DataFrame:
    """A feature table after rows that lacked a digest got it, by the plan of a scan."""
    e = table(spark, d, "events")
    key = F.md5(F.col("user_id").cast("string"))
    now = e.select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"), key.alias("qd64"))
    digest = F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(key)
    was = stored(e.select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"), digest.alias("qd64"), (F.col("event_id") % 4).cast("int").alias("features_at")))
    plan = diff.cache_plan(now.select("path"), now, was, 1).where("plan = 'upgrade'").select("path")
    return diff.merged(was, now.join(plan, "path", "left_semi").select("path", "qd64"), "path").select("path", "qd64", "features_at")


def catalogue_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of parts as a catalogue of ads."""
    p = table(spark, d, "part")
    ads = p.select(F.col("p_name").alias("rel"), F.col("p_partkey").alias("size"), (F.col("p_size") + 0.5).alias("mtime"), F.nullif(F.col("p_partkey") % 50, F.lit(0)).alias("phash"))
    return diff.catalogue_digests(ads, 95.0, "1")


def library_counts(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "events").select(F.col("user_id").alias("folder_path"))
    return upkeep.counts(_catalogue(spark, d), images)


def folder_hints(spark: SparkSession, d: str) -> DataFrame:
    """Stored hints of folders whose direct children are as they were."""
    e = table(spark, d, "events").select(F.col("user_id").alias("folder"), F.concat("event_type", F.col("event_id")).alias("name"), F.col("ts").cast("timestamp").alias("mtime"))
    now = diff.folder_signature(e).select(F.col("folder").alias("root"), "signature")
    was = diff.folder_signature(e.where("folder % 4 <> 0 or name not like 'error%'")).select(F.col("folder").alias("root"), "signature")
    found = e.select(F.col("folder").alias("root"), F.col("name").alias("path"))
    return upkeep.hints(found.join(was, "root"), now)


def sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of groups of orders, whose lines are members with labels of several kinds."""
    l = table(spark, d, "lineitem")  # noqa: E741
    label = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.format_string("%.1f", F.col("l_quantity")), F.lit("%"))).when(F.col("l_linestatus") == "O", F.lit("跨名"))
        .when(F.col("l_linenumber") % 2 == 0, F.lit("重複 (似廣告)")).otherwise(F.lit("無修正"))
    )
    tag = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 4), "ad_like")
    matches = l.select(F.col("l_orderkey").alias("leader"), F.col("l_linenumber").alias("item"), label.alias("label"), tag.alias("tag"))
    orders = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("ctime"))
    return selection.sort_keys(matches, orders).select("leader", "count", "similarity", "ad_like", "size", "filename")


def groups_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Places of groups by the size of their leader, the smallest first."""
    keys = stored(sort_keys(spark, d))
    return selection.display_order(keys.select("leader", "ad_like", "size"), "size", falling=False)


def batch_order(spark: SparkSession, d: str) -> DataFrame:
    """Files in the order they are read, with their place in a folder's run of reads."""
    files = table(spark, d, "events").select(F.col("user_id").alias("folder"), F.concat("event_type", F.col("event_id")).alias("name"))
    placed = stored(tail.batch_order(files).withColumn("at", F.monotonically_increasing_id()))
    first = placed.groupBy("folder").agg(F.min("at").alias("first"))
    return placed.join(first, "folder").select("folder", "name", (F.col("at") - F.col("first")).alias("place"))


def tag_failed_report(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as records whose tagging failed, with the artist and group of their titles."""
    s = table(spark, d, "supplier")
    title = (
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("[DL] [circle "), F.col("s_suppkey"), F.lit(" (the artist)] Title [English]")))
        .when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("(C99) [Known One][other name] Title"))).when(F.col("s_suppkey") % 4 == 2, F.lit("[known grp] T [日本]"))
        .otherwise(F.col("s_name"))
    )
    status = F.when(F.col("s_suppkey") % 5 == 0, "tagged").otherwise("tag-failed")
    rows = s.select(F.col("s_suppkey").alias("path"), title.alias("title"), F.when(F.col("s_suppkey") % 2 == 0, "u").alias("url"), status.alias("status"))
    return sync.failure_report(rows, {"known one": "Known-One"}, {"known grp": "Known-Group"})


def title_names(spark: SparkSession, d: str) -> DataFrame:
    """Artist and group of titles by nations as the dictionary of artists and regions as that of groups."""
    nations = {r.n: r.n.title() + "!" for r in table(spark, d, "nation").select(F.lower("n_name").alias("n")).collect()}
    regions = {r.r: r.r.title() + "?" for r in table(spark, d, "region").select(F.lower("r_name").alias("r")).collect()}
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.select("n_nationkey", F.concat(F.lit("[chinese] ["), "r_name", F.lit(" ("), "n_name", F.lit(")] x ["), "r_name", F.lit("]")).alias("title"))
    who = T.named_in(nations, regions)(F.col("title"))
    return rows.select("n_nationkey", who.alias("w")).select("n_nationkey", "w.artist", F.col("w.group").alias("group"))


_Q = (
    folder_backfill, folder_missing, library_counts, quarantine_union, first_scan_tails, rescan_tails, feature_upgrade, catalogue_digests, folder_hints,
    sort_keys, groups_by_size, batch_order, tag_failed_report, title_names,
)
QUERIES = {q.__name__: q for q in _Q}

_P = r"""p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^[a-z]+://', '') AS u,
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 7 = 0 THEN NULL ELSE 'known' END AS f FROM pages)"""
_KEYS = """l AS (SELECT l_orderkey AS leader, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS number,
    CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' THEN 3 WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS weight,
    l_linestatus = 'F' AND l_linenumber = 4 AS ad FROM lineitem),
keys AS (SELECT leader, count(*) + 1 AS count, coalesce(max(number), max(weight))::DOUBLE AS similarity, bool_or(ad) AS ad_like,
    coalesce(any_value(o_custkey), 0) AS size, leader::VARCHAR AS filename
  FROM l LEFT JOIN orders ON o_orderkey = leader AND o_orderkey % 3 <> 0 GROUP BY 1)"""

SQL = {
    "folder_backfill": rf"""WITH {_P} SELECT page_id, CASE WHEN f <> '' THEN f WHEN page_id % 3 = 0 THEN regexp_extract(u || '.cbz', '^(.*)/[^/]*$', 1) ELSE u END AS folder_path FROM p""",
    "folder_missing": f"WITH {_P} SELECT count(*) AS missing FROM p WHERE coalesce(f, '') = ''",
    "library_counts": f"WITH {_CAT} SELECT (SELECT count(*) FROM cat) AS records, (SELECT count(*) FROM cat WHERE status = 'non-tag') AS untagged, count(*) AS pages, count(DISTINCT user_id) AS folders FROM events",
    "quarantine_union": "SELECT DISTINCT '/q/' || user_id::VARCHAR AS path FROM events WHERE event_type IN ('signup', 'error')",
    "first_scan_tails": """SELECT conv_id, 'p' || turn::VARCHAR || '.jpg' AS name, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INTEGER AS rank FROM conversations
QUALIFY rank <= CASE WHEN conv_id % 3 = 0 THEN 4 ELSE 2 END""",
    "rescan_tails": """SELECT user_id, event_id AS path, (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC))::INTEGER AS rank FROM events
WHERE event_id % 11 <> 0 AND user_id IN (SELECT user_id FROM events WHERE event_id % 11 = 0 AND event_id % 3 <> 0) QUALIFY rank <= 3""",
    "feature_upgrade": """SELECT event_id AS path, CASE WHEN event_id % 5 <> 0 OR event_id % 4 & 1 <> 0 THEN md5(user_id::VARCHAR) END AS qd64, (event_id % 4)::INTEGER AS features_at FROM events""",
    "catalogue_digests": """WITH f AS (SELECT sha256('{"rel":"' || p_name || '","size":' || p_partkey || ',"mtime":' || p_size || '}') AS h FROM part),
c AS (SELECT sha256('{"phash":"' || lpad(printf('%x', p_partkey % 50), 16, '0') || '"}') AS h FROM part WHERE p_partkey % 50 <> 0),
fb AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM f GROUP BY 1), cb AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM c GROUP BY 1),
m AS (SELECT (SELECT sha256(string_agg(b || h, ',' ORDER BY b || h)) FROM fb) AS manifest_digest, (SELECT sha256(string_agg(b || h, ',' ORDER BY b || h)) FROM cb) AS content_digest,
  sha256('{"engine_version":"1","similarity_threshold":95.0}') AS params_digest)
SELECT *, sha256(content_digest || params_digest) AS catalogue_digest FROM m""",
    "folder_hints": """SELECT user_id AS root, event_type || event_id::VARCHAR AS path FROM events
WHERE user_id % 4 <> 0 OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""",
    "sort_keys": f"WITH {_KEYS} SELECT * FROM keys",
    "groups_by_size": f"WITH {_KEYS} SELECT leader, ad_like, size, (row_number() OVER (ORDER BY ad_like DESC, size, leader))::INTEGER AS place FROM keys",
    "batch_order": """SELECT user_id AS folder, event_type || event_id::VARCHAR AS name,
  row_number() OVER (PARTITION BY user_id ORDER BY lower(event_type || event_id::VARCHAR)) - 1 AS place FROM events""",
    "tag_failed_report": """WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '[DL] [circle ' || s_suppkey::VARCHAR || ' (the artist)] Title [English]' WHEN 1 THEN '(C99) [Known One][other name] Title'
    WHEN 2 THEN '[known grp] T [日本]' ELSE s_name END AS title FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT title AS "Title", s_suppkey::VARCHAR AS "Filepath", CASE WHEN s_suppkey % 2 = 0 THEN 'u' ELSE '' END AS "URL",
  CASE s_suppkey % 4 WHEN 0 THEN 'The Artist' WHEN 1 THEN 'Known-One' WHEN 2 THEN '日本' ELSE '' END AS "Artist (Romaji)",
  CASE s_suppkey % 4 WHEN 0 THEN 'Circle ' || s_suppkey::VARCHAR WHEN 1 THEN 'Other Name' WHEN 2 THEN 'Known-Group' ELSE '' END AS "Group (Romaji)" FROM t""",
    "title_names": """SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || '!' AS artist,
  array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || '?' AS "group" FROM nation JOIN region ON n_regionkey = r_regionkey""",
}
