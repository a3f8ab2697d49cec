"""Corpus pipeline: documents in, training mix out.

Each stage takes the whole table that the one before it kept, applies its
operator's decisions, and returns the columns of ``documents`` (the last adds
``copy``). ``run`` writes each stage to the shared folder and reads it again, so
a stage never recomputes its predecessors, also when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, mixing, neardup, quality, secrets
from lodestar.llm.session import bounded, table, unused
from lodestar.llm.storage import materialise

#: A document is rejected below this probability of good quality.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labelled documents, accepts.

    A null or empty text has all statistics 0 and is judged by these; repeated rows are
    judged alike; a text is read whole. Columns of any name pass through.
    """
    bounded(spark)
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return quality.score(docs, model, name=name).filter(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the one with the smallest id, or, in a class
    where no row has an id, the one whose text sorts first.

    Rows that share the smallest id of a class keep the text that sorts first. Texts
    without words, and null ones, aren't duplicates of each other, but for those of
    one id. Columns of any name pass through.
    """
    bounded(spark)
    return neardup.keepers(docs, nameless_apart=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, of any length, in any place.

    A null or empty text holds none and stays; so does every row if the benchmark is
    empty. Columns of any name pass through.
    """
    bounded(spark)
    name = unused(docs, "matches")
    found = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), name=name, least_words=1)
    return found.filter(F.size(name) == 0).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark and counts the characters of changed texts anew.

    Rows without a secret stay as they are, null texts too. Columns of any name pass through.
    """
    return secrets.redacted(docs, length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that all sources have equal weight; adds ``copy``.

    A null source is a source of its own. Repeated rows draw one by one. Columns of any other
    name pass through.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the near-duplicate classes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
