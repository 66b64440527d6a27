"""A corpus cleaned, deduplicated, decontaminated, mixed and packed, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echosieve.llm import decontam, mixing, ngram_join, packing, toxicity
from echosieve.llm.storage import dropped, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the labels doesn't reject.

    Null and empty texts stay; rows that repeat share their fate; without labels the fixed terms alone judge; an
    empty table gives none. Extra columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles with a similarity of 0.8 or more link, that of least doc_id.

    Rows without doc_id or without words stay; of rows that repeat doc_id and text one stays; rows that share a
    doc_id are judged by their own texts. Texts are compared whole, however long. An empty table gives none.
    """
    return ngram_join.keep_one(docs, ngram_join.Jaccard(words=5, num=4, den=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item; an item of fewer words is one window.

    Null and empty texts stay, and with an empty benchmark all do; rows that share a doc_id are judged by their
    own texts. An empty table gives none.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of sources by weights 5, 2, 1 takes them; a null source is one of its own.

    Documents without words are kept once; rows that repeat a doc_id are counted together. An empty table gives
    none. Equal input gives equal rows.
    """
    return mixing.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rows of 2,048.

    Null and empty texts are one end token; longer texts become pieces; rows that repeat are packed each; a null
    doc_id stays null. An empty table gives no rows.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: SQL can express neither the learned lexicon nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each to what the one before wrote, and delete what no stage reads any more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, docs = docs, written(found, name)
            dropped(before)
        else:
            docs = found
    return docs
