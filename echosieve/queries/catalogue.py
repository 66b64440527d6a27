"""Queries of the catalogue: differences with a listing, changes, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles as T
from ..operators import sync
from .tables import table


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Customers as catalogue records."""
    c = table(spark, d, "customer")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "file_deleted").when(F.col("c_mktsegment") == "MACHINERY", "已刪除").when(F.col("c_mktsegment") == "FURNITURE", "tag-failed").otherwise("non-tag")
    return c.where("c_custkey % 13 <> 0").select(
        F.col("c_custkey").alias("path"), F.sha1((F.col("c_custkey") % 700).cast("string")).alias("hash"), status.alias("status"),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(1).alias("exist"), F.when(F.col("c_nationkey") % 7 == 0, 1).otherwise(0).alias("hiddenBook"),
        F.col("c_name").alias("title"), (F.col("c_custkey") % 9).alias("pageCount"), (F.col("c_custkey") % 4).alias("filecount"),
    )


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("path"))


def catalog_sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.sync_plan(_listing(spark, d), _catalogue(spark, d))


def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    return sync.summary(catalog_sync_diff(spark, d))


def catalog_after_sync(spark: SparkSession, d: str) -> DataFrame:
    new = _listing(spark, d).select("path", F.sha1(F.col("path").cast("string")).alias("hash"), F.lit("non-tag").alias("status"), F.lit(1).alias("exist"), F.lit(0).alias("hiddenBook"))
    return sync.synced(_catalogue(spark, d), catalog_sync_diff(spark, d), new).select("path", "hash", "status", "exist", "hiddenBook", "title")


def metadata_status_sync(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.range(0, 800).select(F.sha1(F.col("id").cast("string")).alias("hash"), F.when(F.col("id") % 3 == 0, "deleted").when(F.col("id") % 3 == 1, "ok").alias("status"))
    return sync.metadata_changes(_catalogue(spark, d), keys)


def ghost_records(spark: SparkSession, d: str) -> DataFrame:
    return sync.ghosts(_catalogue(spark, d), _listing(spark, d)).select("path", "status")


def pagediff_repair(spark: SparkSession, d: str) -> DataFrame:
    return sync.page_differences(_catalogue(spark, d)).select("path", "pageCount", "filecount", "repaired")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    odd = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("[DL] ["), "n_name", F.lit(" ("), F.col("s_name"), F.lit(")] Title")))
    return s.select("s_suppkey", odd.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("(C99) [English]["), F.col("n_name"), F.lit("] Other 2"))).otherwise(F.col("s_name")).alias("title"))


def title_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = F.get(T.title_tags(F.col("title")), F.lit(0))
    return _titles(spark, d).select("s_suppkey", "title", T.tag_artist(tag).alias("artist"), T.tag_group(tag).alias("group"), T.is_ascii(F.col("title")).alias("plain"))


def tag_failed_export(spark: SparkSession, d: str) -> DataFrame:
    return sync.tag_failures(_catalogue(spark, d)).select("path", "title", "hash")


def fuzzy_tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Misspelled nation names looked up among the right ones, by exact name first and nearest name then."""
    names = table(spark, d, "nation").select(F.lower("n_name").alias("n"), "n_nationkey")
    keys = [r.n for r in names.select("n").orderBy("n").collect()]
    asked = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    asked = asked.select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "x").otherwise(""), F.col("n_name"), F.when(F.col("s_suppkey") % 5 == 0, "zzzzzz").otherwise("")).alias("asked"))
    found = asked.withColumn("n", T.close_match(keys)(F.col("asked")))
    return found.join(F.broadcast(names), "n", "left").select("s_suppkey", "asked", F.col("n").alias("found"), "n_nationkey")


def url_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").where("page_id % 2 = 0").select(F.concat(F.lit("Customer#"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("name"), "url")
    return _catalogue(spark, d).select("path", "title").join(p, F.col("title") == F.col("name"), "left").select("path", F.coalesce("url", F.lit("")).alias("url"))


def dashboard_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    known = p.where("page_id % 3 <> 0").groupBy("url").agg(F.min("page_id").alias("name"), F.lit("old").alias("status"))
    status = F.when(F.col("page_id") % 4 == 0, "old").otherwise("done")
    new = p.where("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("name"), F.min_by(status, "page_id").alias("status"))
    return sync.dashboard(known, new)


_Q = (
    catalog_sync_diff, sync_summary, catalog_after_sync, metadata_status_sync, ghost_records, pagediff_repair, title_tags,
    tag_failed_export, fuzzy_tag_lookup, url_lookup, dashboard_upsert,
)
QUERIES = {q.__name__: q for q in _Q}

_CAT = """cat AS MATERIALIZED (SELECT c_custkey AS path, sha1((c_custkey % 700)::VARCHAR) AS hash,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'file_deleted' WHEN 'MACHINERY' THEN '已刪除' WHEN 'FURNITURE' THEN 'tag-failed' ELSE 'non-tag' END AS status,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS exist, CASE WHEN c_nationkey % 7 = 0 THEN 1 ELSE 0 END AS hidden, c_name AS title,
  c_custkey % 9 AS pc, c_custkey % 4 AS fc FROM customer WHERE c_custkey % 13 <> 0),
flags AS MATERIALIZED (SELECT *, status IN ('file_deleted', '已刪除') AS gone, status IN ('file_deleted', '已刪除') OR exist = 0 OR hidden = 1 AS partly FROM cat),
listing AS MATERIALIZED (SELECT DISTINCT o_custkey AS path FROM orders WHERE o_custkey % 4 <> 0),
plan AS MATERIALIZED (SELECT coalesce(c.path, l.path) AS path, CASE WHEN c.path IS NULL THEN 'add'
    WHEN l.path IS NULL THEN CASE WHEN NOT gone OR exist <> 0 OR hidden <> 1 THEN 'soft_delete' ELSE 'keep' END
    WHEN partly THEN 'restore' ELSE 'keep' END AS action FROM flags c FULL JOIN listing l ON l.path = c.path)"""
_TITLES = """titles AS (SELECT s_suppkey, n_name, s_name, CASE s_suppkey % 3 WHEN 0 THEN '[DL] [' || n_name || ' (' || s_name || ')] Title' WHEN 1 THEN '(C99) [English][' || n_name || '] Other 2' ELSE s_name END AS title
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

SQL = {
    "catalog_sync_diff": f"WITH {_CAT} SELECT path, action FROM plan",
    "sync_summary": f"WITH {_CAT} SELECT action, count(*) AS n FROM plan GROUP BY 1",
    "catalog_after_sync": f"""WITH {_CAT} SELECT c.path, hash, CASE action WHEN 'soft_delete' THEN 'file_deleted' WHEN 'restore' THEN 'non-tag' ELSE status END AS status,
  CASE action WHEN 'soft_delete' THEN 0 WHEN 'restore' THEN 1 ELSE exist END AS exist, CASE action WHEN 'soft_delete' THEN 1 WHEN 'restore' THEN 0 ELSE hidden END AS "hiddenBook", title
FROM cat c JOIN plan p ON p.path = c.path UNION ALL SELECT path, sha1(path::VARCHAR), 'non-tag', 1, 0, NULL FROM plan WHERE action = 'add'""",
    "metadata_status_sync": f"""WITH {_CAT}, s AS (SELECT hash, bool_or(gone OR exist = 0) AS g, bool_or(NOT gone AND exist = 1) AS l FROM flags GROUP BY 1),
m AS (SELECT sha1(id::VARCHAR) AS hash, CASE id % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'ok' END AS old FROM (SELECT unnest(range(0, 800)) AS id)),
r AS (SELECT hash, old, CASE WHEN g AND NOT l AND old IS DISTINCT FROM 'deleted' THEN 'file_deleted' WHEN l AND old = 'deleted' THEN 'tagged' END AS new FROM m JOIN s USING (hash))
SELECT * FROM r WHERE new IS NOT NULL""",
    "ghost_records": f"WITH {_CAT} SELECT path, status FROM flags WHERE NOT partly AND path NOT IN (SELECT path FROM listing)",
    "pagediff_repair": f"""WITH {_CAT} SELECT path, pc AS "pageCount", fc AS filecount, fc AS repaired FROM cat WHERE pc <> fc AND status <> 'non-tag'""",
    "title_tags": f"""WITH {_TITLES} SELECT s_suppkey, title, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN n_name END AS artist, CASE s_suppkey % 3 WHEN 0 THEN n_name END AS "group", true AS plain FROM titles""",
    "tag_failed_export": f"WITH {_CAT} SELECT path, title, hash FROM cat WHERE status = 'tag-failed'",
    "url_lookup": f"""WITH {_CAT} SELECT path, coalesce(url, '') AS url FROM cat LEFT JOIN (SELECT 'Customer#' || lpad(page_id::VARCHAR, 9, '0') AS name, url FROM pages WHERE page_id % 2 = 0) ON name = title""",
    "dashboard_upsert": """WITH o AS (SELECT url, min(page_id) AS name, 'old' AS status FROM pages WHERE page_id % 3 <> 0 GROUP BY 1),
n AS (SELECT url, min(page_id) AS name, arg_min(CASE WHEN page_id % 4 = 0 THEN 'old' ELSE 'done' END, page_id) AS status FROM pages WHERE page_id % 2 = 0 GROUP BY 1)
SELECT coalesce(n.url, o.url) AS url, coalesce(n.name, o.name) AS name, coalesce(n.status, o.status) AS status,
  CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL OR (n.name = o.name AND n.status = o.status) THEN 'same' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.url = n.url""",
}
