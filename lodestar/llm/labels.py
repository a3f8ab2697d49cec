"""Bounded, deterministic choice of labelled training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 5; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out fold.

    The labels are those of the ``limit`` smallest ids by a hash, and of their documents
    the ``limit`` smallest by a hash of id and text, so neither choice
    depends on partitioning or on a lost executor. Only ids are broadcast, and only they
    and hashes are sorted, hence both are bounded by ``limit``. An id with several labels
    takes the largest; an id that occurs in several documents trains on each different
    text, once.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    texts = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_m"))
    met = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_m", "y", "text")
    names = met.select("doc_id", "_m").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_m").limit(limit).select(F.col("doc_id").alias("_i"), F.col("_m").alias("_n"))
    kept = met.join(F.broadcast(names), (F.col("doc_id") == F.col("_i")) & (F.col("_m") == F.col("_n")))
    return kept.groupBy("doc_id", "_m").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("doc_id", "text", "y")
