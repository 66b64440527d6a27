"""The operators of this subpackage as queries over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lm, mixing, ngram_join, packing, pii, sharding, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]

#: Shards that op6 places documents on.
SHARD_NAMES = tuple(f"shard-{i:03d}" for i in range(64))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a lexicon learned from the labels that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), ngram_join.Jaccard(3, 9, 10))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose vec_id is divisible by 50."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, read back from deduplicated archives."""
    return warc.archived(_table(spark, sf_dir, "pages"), 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document by its doc_id."""
    return sharding.place(spark, _table(spark, sf_dir, "documents"), "doc_id", SHARD_NAMES)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside occurrences of 10-word benchmark windows."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of sources by weights 5, 2, 1 takes."""
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in packed rows."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return lm.scores(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """Every query by name."""
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii": op2_pii,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_warc": op5_warc,
        "op6_sharding": op6_sharding,
        "op7_decontamination": op7_decontamination,
        "op8_mixing": op8_mixing,
        "op9_packing": op9_packing,
        "op10_lm_scoring": op10_lm_scoring,
    }
