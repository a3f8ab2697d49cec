"""Mixing sources to target weights by Poisson replication.

With target weights w, a mix of ``total`` documents (default: as many as there
are) gives the documents of source s a mean repetition rate
``total * w_s / sum(w) / n_s``. Each document's number of copies is drawn from
the Poisson distribution of that rate by inverting its distribution function
at a uniform number that is a hash of seed, id, text, the row's number among equal rows, and draw. The rate is
split into equal draws of mean 8 or less, whose sum is Poisson of the full
rate; so no power underflows and tables stay short. As a global shuffle, a hash of
each copy deals it to a partition and orders it there, in one exchange.

A draw depends only on what the row holds, seed and rate: a lost executor's rows come back the
same, and the number of partitions plays no part. Rows whose ids are null or repeat draw one by one: where
an id and text occur several times, rows that are equal altogether are counted, and their
numbers dealt out in blocks of BLOCK, so that no task makes all copies of a row.

Rates are counted by source first; where there are at most SMALL_SOURCES of them
they are broadcast, otherwise they are joined by sort and merge, and adaptive
execution splits a source that holds very many rows.

Defined cases: a null source is a source of its own; weights default to equal
ones, sources absent from ``weights`` get weight 0 and no copies; null ids and texts hash
as empty ones. Repeated rows draw one by one; rows of one id and text that differ in
another column draw alike. Empty tables give empty mixes. An input column ``copy`` is replaced; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import materialise

SMALL_SOURCES = 20_000
MEAN_OF_DRAW = 8.0
#: The distribution function of mean 8 is 1 within a double's precision beyond.
TERMS = 60
#: Equal rows that one task numbers.
BLOCK = 10_000


def uniform(*parts: Column | str) -> Column:
    """52 bits of an md5 as a number in [0, 1)."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """Array of P(X <= k) for k below TERMS, X Poisson of ``mean``."""
    logs = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(TERMS)])
    terms = F.transform(logs, lambda g, k: F.exp(k.cast("double") * F.ln(mean) - mean - g))
    return F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda n: F.aggregate(F.slice(terms, 1, n), F.lit(0.0), lambda t, x: t + x))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, source: str = "source") -> tuple[DataFrame, int]:
    """(source, n, rate, draws, cdf) by source, and the number of sources.

    Weights are joined as a table, so their number doesn't lengthen the plan.
    """
    spark = docs.sparkSession
    counted = docs.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n"))
    if weights is None:
        counted = counted.withColumn("w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], f"k {docs.schema[source].dataType.simpleString()}, w double")
        counted = counted.join(given, F.col("s").eqNullSafe(F.col("k")), "left").select("s", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    counted = materialise(counted, "rates")
    sums = counted.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("sources")).first()
    aim = float(total if total is not None else sums["n"] or 0)
    rate = F.lit(aim) * (F.col("w") / F.lit(sums["w"])) / F.col("n") if sums["w"] else F.lit(0.0)
    counted = counted.withColumn("rate", rate).withColumn("draws", F.ceil(F.col("rate") / MEAN_OF_DRAW).cast("int"))
    mean = F.col("rate") / F.col("draws")
    return counted.select("s", "n", "rate", "draws", F.when(F.col("draws") > 0, cumulative(mean)).alias("cdf")), sums["sources"]


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (row, key, of) with ``number``, from 0, among equal ones."""
    if rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows.withColumn("number", F.lit(0).cast("bigint"))
    counted = rows.groupBy("row", "key", "of").agg(F.count("*").alias("n"))
    blocks = counted.select("row", "key", "of", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    first = F.col("block") * BLOCK
    numbers = F.sequence(first, F.least(first + BLOCK, F.col("n")) - 1)
    return blocks.repartition("key", "block").select("row", "key", "of", F.explode(numbers).alias("number"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, seed: int = 17, id_col: str = "doc_id", source: str = "source", shuffle: bool = True, text_col: str = "text") -> DataFrame:
    """``docs`` with column ``copy`` (from 0), each row as often as it was drawn.

    The row travels as one column, so none of its names can clash with those used here.
    Without a column ``text_col`` rows draw by their ids alone.
    """
    by_source, sources = rates(docs, weights, total, source)
    names = [c for c in docs.columns if c.lower() != "copy"]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")) if text_col in docs.columns else F.lit("")
    key = F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    rows = _numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"), F.col(f"`{source}`").alias("of")))
    joined = rows.join(F.broadcast(by_source) if sources <= SMALL_SOURCES else by_source, F.col("of").eqNullSafe(F.col("s")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.lit(str(seed)), F.col("key"), F.col("number").cast("string"), j.cast("string")))
    counts = F.transform(numbers, lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    drawn = F.when(F.col("draws") > 0, F.aggregate(counts, F.lit(0), lambda t, x: t + x)).otherwise(0)
    copies = joined.select("row", "key", "number", drawn.alias("copies")).filter("copies > 0")
    kept = copies.select("row", "key", "number", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    if shuffle:
        kept = kept.withColumn("place", F.xxhash64(F.lit(seed), F.col("key"), F.col("number"), F.col("copy"))).repartition("place").sortWithinPartitions("place", "key", "number")
    return kept.select("row.*", "copy")
