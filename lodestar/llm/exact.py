"""Exact deduplication that no hot text can stall.

1. Each task combines its own rows of one digest and one whole text.
2. What is left is dealt by digest, text and a salt, the number of its task modulo SALTS, and combined:
   a text that every task holds becomes SALTS groups.
3. The winners of the salts are combined by digest and text.

Each step groups by the digest and the whole text, so Spark compares contents, not digests; each keeps the
largest id and the number of rows. Rows then get their group's winner by digest, without
their texts; only where a digest stands for several texts (never seen for SHA-256, the
default) are the texts of that digest compared once more. This join is salted too: a group's
winner is sent to the salts that its rows have, and none holds more than its share of rows.

Texts are moved twice: once as each task's distinct texts, once as the winners of salts. Memory
follows Spark's aggregation, which spills.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null id is
smaller than any other; of rows with the same text and largest id (or of rows that all have a null id)
one stays. Extra columns of any name are ignored by ``groups`` and pass through ``deduplicated``. An
empty table gives an empty one. A text is compared whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import materialise

SALTS = 64


def _same(column: Column) -> Column:
    return column


def _plain(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame:
    """i, t, h (SHA-256 of the text), d (digest), p (salt by task)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), normalise(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t"), (F.spark_partition_id() % SALTS).alias("p"))
    rows = rows.select("*", F.sha2("t", 256).alias("h"))
    return rows.select("*", digest(F.col("h")).alias("d"))


def _answered(named: DataFrame, won: DataFrame, keys: list[str]) -> DataFrame:
    """``named`` with its group's ``keep`` and ``size``, met by ``keys`` and salt."""
    pairs = named.select(*keys, "s").distinct()
    first = pairs.groupBy(*keys).agg(F.min("s").alias("s0"))
    placed = pairs.join(won.join(first, keys), keys)
    return named.join(placed, [*keys, "s"])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = _same, digest: Callable[[Column], Column] = _same) -> DataFrame:
    """One row for each row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    ``normalise`` makes the text that is compared; ``digest`` is a function of its SHA-256 in
    hexadecimal that groups are dealt by.
    """
    rows = _plain(docs, id_col, text_col, normalise, digest)
    salted = rows.groupBy("d", "p", "t").agg(F.max("i").alias("i"), F.count("*").alias("n"))
    whole = salted.groupBy("d", "t").agg(F.max("i").alias("keep"), F.sum("n").alias("size"))
    by_digest = materialise(whole.groupBy("d").agg(F.count("*").alias("texts"), F.max("keep").alias("keep"), F.max("size").alias("size")), "digests")

    salt = F.when(F.col("i").isNull(), F.col("p")).otherwise(F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).alias("s")
    named = materialise(rows.select("h", "d", "i", salt).groupBy("h", "d", "s", "i").agg(F.count("*").alias("n")), "named")
    columns = ["i", "s", "s0", "n", "h", "keep", "size"]
    found = _answered(named, by_digest.filter("texts = 1").drop("texts"), ["d"]).select(*columns)

    unlike = by_digest.filter("texts > 1").select("d")
    if not unlike.isEmpty():
        some = rows.join(unlike, "d", "left_semi").select("h", "d", "t", "i", salt).groupBy("h", "d", "t", "s", "i").agg(F.count("*").alias("n"))
        some = materialise(some, "unlike")
        found = found.unionByName(_answered(some, whole.join(unlike, "d", "left_semi"), ["d", "t"]).select(*columns))

    each = found.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))
    kept = F.col("i").eqNullSafe(F.col("keep")) & (F.col("k") == 1) & (F.col("keep").isNotNull() | (F.col("s") == F.col("s0")))
    return each.select(F.col("i").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("h").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = _same, digest: Callable[[Column], Column] = _same) -> DataFrame:
    """The rows of ``docs`` that stay, whole, by the same three steps: the row travels with its text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    number = F.xxhash64(*[F.col(f"`{c}`").cast("string") if "map" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes])
    carried = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), row.alias("row"), number.alias("x"))
    rows = _plain(carried.select(F.struct("i", "x", "row").alias("i"), "t"), "i", "t", normalise, digest)
    rows = rows.select("d", "p", "t", F.struct(F.col("i.i").isNotNull().alias("known"), F.col("i.i").alias("i"), F.col("i.x").alias("x")).alias("order"), F.col("i.row").alias("row"))
    best = [F.max_by("row", "order").alias("row"), F.max("order").alias("order")]
    won = rows.groupBy("d", "p", "t").agg(*best).groupBy("d", "t").agg(*best)
    return won.select("row.*")
