"""Queries of the file inventory: scans, changes, tails, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import JUNK_NAMES
from ..functions import dates
from ..functions import hashing as H
from ..functions import paths as P
from ..operators import diff, selection, tail
from ..operators.tables import stored
from .tables import table


def tail_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("p"), F.col("turn"), F.lit(".jpg")).alias("name"))
    return tail.last_pages(pages, "conv_id", "name", 3).select("conv_id", "name", "rank")


def archive_tail_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey")]
    return tail.trim_plan(rows, "l_orderkey", order, 2).select("l_orderkey", "l_linenumber", "l_partkey", "members", "rank")


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"))
    parts = table(spark, d, "part").select("p_partkey", name.alias("name"))
    return parts.select("p_partkey", "name", F.array_join(P.natural_key(F.col("name")), "").alias("key"))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_extract("url", "^([^?#]*)", 1), "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", "url", plain.alias("path"))


def excluded_folders(spark: SparkSession, d: str) -> DataFrame:
    pages = _urls(spark, d).select("page_id", P.folder(F.col("path")).alias("folder"), P.basename(F.col("path")).alias("name"))
    return pages.where(~P.excluded(F.col("folder"), ("de", "m.casino-win.example.com/en")))


def date_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(dates.in_window(F.col("ts"), "2024-01-05", "2024-01-09")).select("event_id", "user_id")


def _folders(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of folders below a root, with times of events."""
    e = table(spark, d, "events").select("ts", F.concat(F.lit("root/g"), F.col("user_id") % 10).alias("g"), "user_id", "event_type")
    level = lambda *c: e.groupBy(F.concat_ws("/", *c).alias("path")).agg(F.max("ts").alias("ts"))
    low = e.where("user_id % 3 <> 0 or day(ts) < 12")
    deep = low.groupBy(F.concat_ws("/", "g", F.col("user_id").cast("string"), "event_type").alias("path")).agg(F.max("ts").alias("ts"))
    middle = low.groupBy(F.concat_ws("/", "g", F.col("user_id").cast("string")).alias("path")).agg(F.max(F.when(F.day("ts") <= 1 + F.col("user_id") % 28, F.col("ts"))).alias("ts"))
    top = level("g")
    root = e.agg(F.min("ts").alias("ts")).select(F.lit("root").alias("path"), "ts")
    return deep.unionByName(middle).unionByName(top).unionByName(root)


def subtree_time_prune(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return diff.subtree_kept(_folders(spark, d), cut, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("path")


def leaf_only_folders(spark: SparkSession, d: str) -> DataFrame:
    return diff.leaves(_folders(spark, d))


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("user_id", "ts", "event_type")
    live = e.where("user_id % 7 <> 0").groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("ts"))
    past = e.where("user_id % 5 <> 0 and (user_id % 2 = 0 or event_type <> 'view')")
    state = past.groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("scanned_count"))
    return live, state


def folder_state_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.folder_changes(*_state(spark, d), needed=40)


def ghost_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """What each setting of the four flags does to vanished folders, every third of which is still there."""
    gone = stored(folder_state_diff(spark, d).where("kind = 'ghost'").select("path", (F.col("path") % 3 == 0).alias("exists")))
    cells = [[bool(i >> k & 1) for k in range(4)] for i in range(16)]
    return reduce(DataFrame.unionByName, (diff.ghost_policy(gone, *c).select("path", F.lit(i).alias("cell"), "action") for i, c in enumerate(cells)))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("path"), F.col("user_id").alias("folder_path"))


def restore_cached(spark: SparkSession, d: str) -> DataFrame:
    same = folder_state_diff(spark, d).where("kind = 'unchanged'")
    return diff.restored(_files(spark, d), same).select("path", "folder_path")


def quarantine_anti(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    bad = table(spark, d, "events").where("event_type = 'error' and value > 5").select(F.col("event_id").alias("path"))
    return diff.task_list(f.where("path % 2 = 0"), f.where("folder_path % 3 = 0"), bad)


def _cache(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    tasks = e.select(F.col("event_id").alias("path"))
    key = F.md5(F.col("user_id").cast("string"))
    now = e.where("event_id % 11 <> 0").select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"), key.alias("qd64"))
    digest = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(key)
    seen = F.when(F.col("event_type") == "click", F.timestamp_micros(F.lit(0)).cast("timestamp_ntz")).otherwise(F.col("ts"))
    was = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("path"), seen.alias("mtime"), digest.alias("qd64"), (F.col("event_id") % 4).cast("int").alias("features_at"))
    return diff.cache_plan(tasks, now, was, 1)


def cache_work_plan(spark: SparkSession, d: str) -> DataFrame:
    return _cache(spark, d)


def cache_plan_counts(spark: SparkSession, d: str) -> DataFrame:
    return diff.plan_counts(_cache(spark, d))


def digest_incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("v2")
    last = F.when(F.col("doc_id") % 3 == 0, "v2").when(F.col("doc_id") % 3 == 1, "v1")
    items = table(spark, d, "documents").select(F.col("doc_id").alias("path"), last.alias("last_ad_digest"))
    found = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("path"))
    return diff.marked(diff.stale(items, now), found, now)


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return diff.digest(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])


def folder_signature(spark: SparkSession, d: str) -> DataFrame:
    children = table(spark, d, "events").select(F.col("user_id").alias("folder"), F.concat("event_type", F.col("event_id")).alias("name"), F.col("ts").cast("timestamp").alias("mtime"))
    return diff.folder_signature(children)


def root_protection(spark: SparkSession, d: str) -> DataFrame:
    """Folders to scan by two roots: one with a picture of its own, which stays, and one without."""
    f = _folders(spark, d).select("path")
    files = table(spark, d, "events").select(F.concat(F.lit("root/g"), F.col("user_id") % 10).alias("folder")).where("folder <> 'root/g3'")
    one, two = (diff.protect_root(f, root, files).select(F.lit(root).alias("root"), "path") for root in ("root/g2", "root/g3"))
    return one.unionByName(two)


def new_folder_expansion(spark: SparkSession, d: str) -> DataFrame:
    f = _folders(spark, d)
    new = f.where("path in ('root/g3', 'root/g7/17')").select("path")
    return diff.with_new_children(f.where("path like '%click'").select("path"), new, f, dates.in_window(F.col("ts").cast("timestamp"), "2024-01-10", "2024-01-30"))


def empty_cache_fallback(spark: SparkSession, d: str) -> DataFrame:
    f = _folders(spark, d)
    return diff.fallback_folders(f.where("path <> 'root'"), f.where("path like '%view'").select(F.col("path").alias("folder_path")))


def empty_folders(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("day(ts) = 7")
    name = F.when(F.col("event_type").isin("view", "click", "error"), "Thumbs.db").otherwise(F.concat(F.col("event_id"), F.lit(".png")))
    folders = table(spark, d, "events").select(F.col("user_id").alias("path"))
    return diff.empty_folders(folders, e.select(F.col("user_id").alias("folder"), name.alias("name")), JUNK_NAMES)


def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), (F.col("c_nationkey") + 100).alias("c_nationkey"))
    return diff.merged(old, new, "c_custkey")


def prefix_delete(spark: SparkSession, d: str) -> DataFrame:
    return diff.without_prefix(_urls(spark, d).select("page_id", "path"), "example.com").union(
        diff.without_prefix(_folders(spark, d).select(F.lit(-1).cast("bigint").alias("page_id"), "path"), "root/g1")
    )


def vpath_parse(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("zip://"), F.col("path"), F.lit("!a/"), F.col("page_id"), F.lit(".JPG"))).otherwise(F.col("path"))
    rows = _urls(spark, d).select("page_id", v.alias("v"))
    p = F.col("v")
    return rows.select(
        "page_id", P.is_virtual(p).alias("is_virtual"), P.archive_of(p).alias("archive"), P.inner_of(p).alias("inner"),
        P.container(p).alias("container"), P.extension(p).alias("ext"),
    )


def normalized_paths(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("file:///Data//"), F.regexp_replace("path", "/", r"\\\\"), F.lit("/./"))
    rows = _urls(spark, d).select("page_id", raw.alias("raw"), "url")
    return rows.select("page_id", P.normalized(F.col("raw")).alias("path"), P.sanitized(F.col("url")).alias("name"), F.sha1(P.normalized(F.col("raw"))).alias("id"))


def hex_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    h = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 16)
    return table(spark, d, "customer").select("c_custkey", H.from_hex(h).alias("phash"), H.valid(H.from_hex(h)).alias("ok"))


def backup_retention(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").select(F.col("event_id").alias("backup"), (F.col("user_id") % 5).alias("kind"), "ts")
    return tail.retained(b, "kind", "ts", 10, F.lit("2024-01-30").cast("timestamp_ntz")).select("backup", "kind", "rank")


def unique_ad_names(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_name")
    taken = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("ad_"), "p_name", F.lit(".png")).alias("name"))
    return tail.unique_names(items, "p_name", taken).select("path", "copy_name")


def undo_pending(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    none = spark.createDataFrame([], "batch_id int, path long")
    pending = none
    for kind, n in (("error", 4), ("signup", 3), ("purchase", 5)):
        pending = selection.mark(pending, e.where((F.col("event_type") == kind) & (F.col("user_id") % n == 0)).select(F.col("user_id").alias("path")))
    return selection.undo(pending)


def commit_pending(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pending = e.where("event_type = 'error'").select(F.lit(1).alias("batch_id"), F.col("event_id").alias("path"))
    return selection.committable(pending, e.where("value > 10").select(F.col("event_id").alias("path")), e.where("value < 1").select(F.col("event_id").alias("path")))


def selection_invert(spark: SparkSession, d: str) -> DataFrame:
    e = _files(spark, d).select("path")
    return selection.inverted(e.where("path % 2 = 0"), e.where("path % 3 = 0"))


def feature_bits(spark: SparkSession, d: str) -> DataFrame:
    bit = lambda on, b: F.when(on, b).otherwise(0)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (bit(F.col("l_tax") > 0.02, 1) + bit(F.col("l_discount") > 0.05, 2)).alias("found"), bit(F.col("l_returnflag") == "R", 8).alias("stored"))
    both = F.col("found").bitwiseOR(F.col("stored"))
    return rows.select("l_orderkey", "l_linenumber", both.alias("features"), (both.bitwiseAND(F.lit(3)) == 3).alias("has_both"))


def date_functions(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(dates.two_months_back(day), "yyyy-MM-dd").alias("start"), dates.iso_millis(ts).alias("iso"), dates.epoch_millis(ts).alias("millis"),
        dates.epoch_millis(dates.folder_time(ts, ts + F.expr("interval 1 day"), "hybrid")).alias("hybrid"),
    )


_Q = (
    tail_pages, archive_tail_plan, natural_sort, excluded_folders, date_window, subtree_time_prune, leaf_only_folders, folder_state_diff,
    ghost_cleanup, root_protection, new_folder_expansion, empty_cache_fallback, restore_cached, quarantine_anti, cache_work_plan, cache_plan_counts, digest_incremental_skip, content_digest,
    folder_signature, empty_folders, snapshot_merge, prefix_delete, vpath_parse, normalized_paths, hex_fingerprints, backup_retention,
    unique_ad_names, undo_pending, commit_pending, selection_invert, feature_bits, date_functions,
)
QUERIES = {q.__name__: q for q in _Q}

_URLS = r"urls AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^[a-z]+://', '') AS path FROM pages)"
_FOLDERS = """e AS (SELECT ts, 'root/g' || (user_id % 10)::VARCHAR AS g, user_id, event_type FROM events),
low AS (SELECT * FROM e WHERE user_id % 3 <> 0 OR day(ts) < 12),
folders AS MATERIALIZED (
  SELECT concat_ws('/', g, user_id::VARCHAR, event_type) AS path, max(ts) AS ts FROM low GROUP BY 1
  UNION ALL SELECT concat_ws('/', g, user_id::VARCHAR), max(CASE WHEN day(ts) <= 1 + user_id % 28 THEN ts END) FROM low GROUP BY 1
  UNION ALL SELECT g, max(ts) FROM e GROUP BY 1 UNION ALL SELECT 'root', min(ts) FROM e)"""
_STATE = """live AS (SELECT user_id AS path, max(ts) AS ts FROM events WHERE user_id % 7 <> 0 GROUP BY 1),
state AS (SELECT user_id AS path, max(ts) AS ts, count(*) AS n FROM events WHERE user_id % 5 <> 0 AND (user_id % 2 = 0 OR event_type <> 'view') GROUP BY 1),
changes AS MATERIALIZED (
  SELECT coalesce(l.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'ghost'
    WHEN l.ts IS DISTINCT FROM s.ts OR n < 40 THEN 'changed' ELSE 'unchanged' END AS kind
  FROM live l FULL JOIN state s ON l.path = s.path)"""
_CACHE = """plan AS (SELECT event_id AS path, CASE
    WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'gone' ELSE 'purge' END
    WHEN event_id % 3 <> 0 AND event_type <> 'click' AND event_id % 4 & 1 <> 0 AND (event_id % 5 = 0 OR event_id % 7 <> 0)
      THEN CASE WHEN event_id % 5 = 0 THEN 'upgrade' ELSE 'hit' END
    ELSE 'recalc' END AS plan FROM events)"""
_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('file:///Data//' || replace(path, '/', '\') || '/./', '^file:/{2,3}', '/'), '\\', '/', 'g'), '/{2,}', '/', 'g'), '/\.(/|$)', '\1', 'g'), '(.)/$', '\1'))"

SQL = {
    "tail_pages": """SELECT conv_id, 'p' || turn::VARCHAR || '.jpg' AS name, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INTEGER AS rank FROM conversations QUALIFY rank <= 3""",
    "archive_tail_plan": """SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS members,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC))::INTEGER AS rank FROM lineitem QUALIFY members > 2 AND rank <= 2""",
    "natural_sort": r"""SELECT p_partkey, name, array_to_string(list_transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)', 1),
  lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x::BIGINT::VARCHAR, 20, '0') ELSE x END), '') AS key
FROM (SELECT p_partkey, concat_ws(' ', p_brand, p_name, p_size::VARCHAR) AS name FROM part)""",
    "excluded_folders": f"""WITH {_URLS}, f AS (SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM urls)
SELECT * FROM f WHERE NOT list_contains(string_split(lower(folder), '/'), 'de') AND lower(folder) <> 'm.casino-win.example.com/en' AND NOT starts_with(lower(folder), 'm.casino-win.example.com/en/')""",
    "date_window": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'",
    "subtree_time_prune": f"""WITH {_FOLDERS} SELECT path FROM folders f WHERE path = 'root' AND ts <= TIMESTAMP '2024-01-30 12:00:00' OR (ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-30 12:00:00'
  AND NOT EXISTS (SELECT 1 FROM folders u WHERE u.path <> 'root' AND starts_with(f.path, u.path || '/') AND u.ts < TIMESTAMP '2024-01-10'))""",
    "leaf_only_folders": f"WITH {_FOLDERS} SELECT DISTINCT path FROM folders f WHERE NOT EXISTS (SELECT 1 FROM folders u WHERE starts_with(u.path, f.path || '/'))",
    "folder_state_diff": f"WITH {_STATE} SELECT path, kind FROM changes",
    "root_protection": f"""WITH {_FOLDERS} SELECT root, path FROM folders, (SELECT unnest(['root/g2', 'root/g3']) AS root)
WHERE path <> root OR root IN (SELECT 'root/g' || (user_id % 10)::VARCHAR FROM events WHERE user_id % 10 <> 3)""",
    "new_folder_expansion": f"""WITH {_FOLDERS} SELECT DISTINCT path FROM folders WHERE path LIKE '%click' OR (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-31'
  AND (path IN ('root/g3', 'root/g7/17') OR starts_with(path, 'root/g3/') OR starts_with(path, 'root/g7/17/')))""",
    "empty_cache_fallback": f"""WITH {_FOLDERS}, m AS (SELECT path FROM folders WHERE path <> 'root' AND NOT (path LIKE '%view'))
SELECT path FROM m f WHERE NOT EXISTS (SELECT 1 FROM m u WHERE starts_with(u.path, f.path || '/'))""",
    "ghost_cleanup": f"""WITH {_STATE} SELECT path, cell::INTEGER AS cell,
  CASE WHEN cell & 3 <> 3 THEN 'drop_all' WHEN cell & 4 = 0 OR path % 3 = 0 THEN 'keep' WHEN cell & 8 <> 0 THEN 'drop_all' ELSE 'drop_state' END AS action
FROM changes, (SELECT unnest(range(0, 16)) AS cell) WHERE kind = 'ghost'""",
    "restore_cached": f"WITH {_STATE} SELECT event_id AS path, user_id AS folder_path FROM events WHERE user_id IN (SELECT path FROM changes WHERE kind = 'unchanged')",
    "quarantine_anti": "SELECT event_id AS path FROM events WHERE (event_id % 2 = 0 OR user_id % 3 = 0) AND NOT (event_type = 'error' AND value > 5)",
    "cache_work_plan": f"WITH {_CACHE} SELECT path, plan FROM plan",
    "cache_plan_counts": f"WITH {_CACHE} SELECT plan, count(*) AS n FROM plan GROUP BY 1",
    "digest_incremental_skip": """SELECT doc_id AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN CASE WHEN doc_id % 3 = 1 THEN 'v1' END ELSE 'v2' END AS last_ad_digest
FROM documents WHERE doc_id % 3 <> 0""",
    "content_digest": """WITH r AS (SELECT sha256('{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}') AS h FROM lineitem),
b AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(b || h, ',' ORDER BY b || h)) AS digest, sum(n)::BIGINT AS n FROM b""",
    "folder_signature": """SELECT user_id AS folder, sha1(string_agg(line, chr(10) ORDER BY line)) AS signature
FROM (SELECT user_id, lower(event_type || event_id::VARCHAR) || '|' || epoch_us(ts)::VARCHAR AS line FROM events) GROUP BY 1""",
    "empty_folders": "SELECT DISTINCT user_id AS path FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE day(ts) = 7 AND event_type NOT IN ('view', 'click', 'error'))",
    "snapshot_merge": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""",
    "prefix_delete": f"""WITH {_URLS}, {_FOLDERS} SELECT page_id, path FROM urls WHERE path <> 'example.com' AND NOT starts_with(path, 'example.com/')
UNION ALL SELECT -1::BIGINT, path FROM folders WHERE path <> 'root/g1' AND NOT starts_with(path, 'root/g1/')""",
    "vpath_parse": rf"""WITH {_URLS}, v AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'zip://' || path || '!a/' || page_id::VARCHAR || '.JPG' ELSE path END AS v FROM urls),
p AS (SELECT page_id, v, regexp_matches(v, '^zip://(.*)!([^!]*)$') AS is_virtual, nullif(regexp_extract(v, '^zip://(.*)!([^!]*)$', 1), '') AS archive FROM v)
SELECT page_id, is_virtual, archive, CASE WHEN is_virtual THEN regexp_extract(v, '^zip://(.*)!([^!]*)$', 2) END AS inner,
  regexp_extract(CASE WHEN is_virtual THEN archive ELSE v END, '^(.*)/[^/]*$', 1) AS container, lower(regexp_extract(regexp_extract(v, '([^/]*)$', 1), '\.([^.]+)$', 1)) AS ext FROM p""",
    "normalized_paths": rf"""WITH {_URLS}, n AS (SELECT page_id, {_NORM} AS path, trim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g')) AS name FROM urls) SELECT *, sha1(path) AS id FROM n""",
    "hex_fingerprints": """SELECT c_custkey, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS phash, u <> 0 AS ok
FROM (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 16))::UBIGINT::HUGEINT AS u FROM customer)""",
    "backup_retention": """SELECT backup, kind, rank FROM (SELECT event_id AS backup, user_id % 5 AS kind, ts, (row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC))::INTEGER AS rank FROM events)
WHERE rank <= 10 OR ts >= TIMESTAMP '2024-01-30'""",
    "unique_ad_names": """SELECT p_partkey AS path, 'ad_' || p_name || CASE WHEN i > 0 THEN '_' || i::VARCHAR ELSE '' END || '.png' AS copy_name
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1
        + (p_name IN (SELECT p_name FROM part WHERE p_partkey % 7 = 0))::INTEGER AS i FROM part)""",
    "undo_pending": """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id % 4 = 0), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0),
c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id % 5 = 0),
p AS (SELECT 1 AS n, user_id FROM a UNION ALL SELECT 1 + ((SELECT count(*) FROM a) > 0)::INTEGER, user_id FROM b WHERE user_id NOT IN (SELECT user_id FROM a)),
q AS (SELECT * FROM p UNION ALL SELECT 1 + (SELECT max(n) FROM p), user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM p))
SELECT n::INTEGER AS batch_id, user_id AS path FROM q WHERE n < (SELECT max(n) FROM q)""",
    "commit_pending": """SELECT event_id AS path, 1 AS batch_id, CASE WHEN value > 10 THEN 'file' ELSE 'empty_folder' END AS kind FROM events WHERE event_type = 'error' AND (value > 10 OR value < 1)""",
    "selection_invert": "SELECT event_id AS path FROM events WHERE (event_id % 2 = 0) <> (event_id % 3 = 0)",
    "feature_bits": """SELECT l_orderkey, l_linenumber, f AS features, f & 3 = 3 AS has_both FROM (SELECT l_orderkey, l_linenumber,
  ((l_tax > 0.02)::INTEGER + 2 * (l_discount > 0.05)::INTEGER) | (CASE WHEN l_returnflag = 'R' THEN 8 ELSE 0 END) AS f FROM lineitem)""",
    "date_functions": """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate::DATE - INTERVAL 2 MONTH), '%Y-%m-%d') AS start, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso,
  epoch_ms(o_orderdate) AS millis, epoch_ms(o_orderdate + INTERVAL 1 DAY) AS hybrid FROM orders""",
}
