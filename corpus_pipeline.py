"""Corpus pipeline: quality rules, toxicity, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``,
whatever they are named, with the rows that it keeps as they are.  In every stage an empty
table gives an empty one, a very long text is worked on whole, rows that repeat are judged
alike, and ids and sources may be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from isoframe.llm import jaccard, mixing, packing, quality, scratch, toxicity

#: Probability of good quality from which on a document stays: only clear rejects go.
KEEP_AT = 0.2
#: Text units whose ids a Python worker remembers while packing; memory of the executors is short after four other stages.
MEMO_UNITS = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model; null and empty texts fail the rules.

    The threshold is lower than that of the operator's own query: only clear rejects go.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), KEEP_AT)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't call toxic; null and empty texts stay."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.TOXIC_AT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null ids come last in a group; rows that repeat an id with another text are texts of
    their own; of rows that repeat id and text one stays; texts without a word all stay.
    """
    return jaccard.without_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair mix: the written files hold it one after the other.

    A null source is one of its own; weights are the square roots of the sources' numbers of rows.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 1024 tokens within windows of the mix; a null or empty text is its end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, keep_order=True, memo_units=MEMO_UNITS)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, a genetic algorithm and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.stage(docs, name.replace(" ", "-"))
    return docs
