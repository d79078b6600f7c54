"""Rows that models may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sizes: dict[int, int]) -> DataFrame:
    """text, label, h of at most ``sizes`` rows of each class, those with the smallest hashes of their ids; of rows that repeat an id the smallest text."""
    ids = None
    for value, n in sizes.items():
        part = labels.where(F.col(column) == value).select("doc_id", F.lit(value).alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    # at most the sum of ``sizes`` rows
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label", F.xxhash64("doc_id").alias("h"))
