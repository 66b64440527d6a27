"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions alone.

An item's windows are sets of consecutive words that must occur whole, so of a window's words, ordered
by rarity, the first alone is the necessary prefix: a place in a document can hold the window only if
that word stands there at the same distance from the window's start. The plan explodes each document's
words beside the document, joins them with the necessary words, drops places where the window would not
fit (positional and length bound) and compares the words there with the window's (exact containment).
One stage of generated code does all that without copying a text or shuffling a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows that one pass broadcasts; a benchmark with more takes more passes over the documents, and one with
#: more than so many passes is joined by shuffles, in one pass.
WINDOWS_A_PASS, MOST_PASSES = 200_000, 4


def words(text: Column) -> Column:
    """Lower-case A-Z and list the runs of letters, digits and characters beyond ASCII; null: none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _GAP), "")


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows of the items: ``win``, ``length`` and the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0)) + 1
    wins = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, size))).alias("win"))
    wins = wins.distinct().groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return wins.withColumn("win_id", F.xxhash64("win"))


def _rarity(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of the windows occurs in all documents."""
    every = docs.select(F.explode(words(F.col("text"))).alias("word"))
    return every.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _necessary(docs: DataFrame, wins: DataFrame, passes: int) -> DataFrame:
    """Per window its rarest word and that word's place in it; unseen words are the rarest."""
    placed = wins.select("win_id", F.posexplode("win").alias("at", "word"))
    vocabulary = placed.select("word").distinct()
    if passes > MOST_PASSES:
        every = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        rarity = every.join(vocabulary, "word", "left_semi")
    else:
        share = lambda i: vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == i)
        rarity = reduce(DataFrame.unionByName, (_rarity(docs, share(i)) for i in range(passes)))
    ranked = placed.join(rarity, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = ranked.groupBy("win_id").agg(F.min(F.struct("n", "word", "at")).alias("first"))
    return wins.join(first, "win_id").select("win_id", "win", F.size("win").alias("length"), "first.word", "first.at")


def _hits(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, n_words, start, length, win_id) of exact occurrences.

    The token table's empty word meets an empty word that is put before each document's words, so each
    row of ``docs`` also gives one row without a window.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), words(F.col("text")).alias("w"))
    each = listed.select("doc_id", "mark", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    fits = (start >= 1) & (start + F.col("length") - 1 <= F.size("w"))
    same = F.when(fits, F.slice("w", F.greatest(start, F.lit(1)), F.col("length")) == F.col("win")).otherwise(F.lit(False))
    held = each.join(F.broadcast(tokens), "word").where((F.col("length") == 0) | same)
    return held.select("doc_id", "mark", F.size("w").alias("n_words"), start.alias("start"), "length", "win_id")


def _joined_hits(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of :func:`_hits` with windows, for more of them than passes may broadcast.

    Words meet the necessary words by a shuffle; places that fit, which are few, then meet their documents.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words(F.col("text")).alias("w"))
    each = listed.select("doc_id", "mark", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    placed = each.join(tokens, "word").withColumn("start", F.col("pos") + 1 - F.col("at"))
    placed = placed.where((F.col("start") >= 1) & (F.col("start") + F.col("length") - 1 <= F.col("n_words")))
    whole = listed.select(F.col("doc_id").alias("k1"), F.col("mark").alias("k2"), "w").dropDuplicates(["k1", "k2"])
    held = placed.join(whole, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("mark") == F.col("k2")))
    held = held.where(F.slice("w", F.col("start"), F.col("length")) == F.col("win"))
    return held.select("doc_id", "mark", "n_words", "start", "length", "win_id")


def _found(docs: DataFrame, benchmark: DataFrame, size: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The windows of the items, and the occurrences in documents; with ``every``, also a row of length 0 per document."""
    wins = written(_windows(benchmark, size), "windows")
    passes = max(1, -(-wins.count() // WINDOWS_A_PASS))
    tokens = written(_necessary(docs, wins, passes), "tokens")
    base = F.struct(
        F.lit(0).cast("long").alias("win_id"), F.array().cast("array<string>").alias("win"),
        F.lit(0).alias("length"), F.lit("").alias("word"), F.lit(0).alias("at"),
    )
    sentinel = docs.sparkSession.range(1).select(base.alias("b")).select("b.*")
    if passes > MOST_PASSES:
        parts = [_joined_hits(docs, tokens)] + [_hits(docs, sentinel)] * every
    else:
        shares = [tokens.where(F.pmod("win_id", F.lit(passes)) == i) for i in range(passes)]
        if every:
            shares[0] = shares[0].unionByName(sentinel)
        parts = [_hits(docs, t) for t in shares]
    return wins, reduce(DataFrame.unionByName, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Find the words of documents that lie inside an occurrence of a benchmark window.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
    window. ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns
    are ignored. Returns a row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``. Null and empty texts have no words; items without words have
    no windows; an empty benchmark hits nothing; no documents, no rows. Rows that repeat doc_id and text
    each get the same result. A null item_id counts as an item without a name and is not reported.
    """
    wins, hits = _found(docs, benchmark, size, True)
    hits = written(hits, "hits")

    rows = hits.where("length = 0").groupBy("doc_id", "mark", "n_words").agg(F.count(F.lit(1)).alias("times"))
    found = hits.where("length > 0").distinct()
    order = Window.partitionBy("doc_id", "mark").orderBy("start", "length", "win_id")
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))
    spread = found.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("length") - begin))
    covered = spread.groupBy("doc_id", "mark").agg(F.sum("new").alias("n_hit"))
    named = found.select("doc_id", "mark", "win_id").distinct().join(wins.select("win_id", F.explode("items").alias("item")), "win_id")
    named = named.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = covered.join(named, (covered.doc_id.eqNullSafe(named.doc_id)) & (covered.mark == named.mark), "left")
    both = both.select(covered.doc_id.alias("k1"), covered.mark.alias("k2"), "n_hit", "items")
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("mark") == F.col("k2")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"),
    ).drop("copy")


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Drop the rows of ``docs`` that hold a benchmark window; all columns stay.

    Rows that share a doc_id are judged by their own texts. Null and empty texts stay, and with an empty
    benchmark all rows do; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bad = _found(docs, benchmark, size, False)[1].select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    bad = written(bad, "contaminated")
    same = docs.doc_id.cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(text) == bad["_bad_mark"])
    return docs.join(bad, same, "left_anti")
