"""Comparing a folder with what is indexed, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.storage import materialise

ACTIONS = ("add", "delete", "update", "touch", "skip")


def classify(in_disk: Column, in_index: Column, same_time: Column, same_hash: Column) -> Column:
    """The action for one path. Equal times settle it before any hash is looked at."""
    return (
        F.when(~in_index, "add").when(~in_disk, "delete")
        .when(same_time, "skip").when(same_hash, "touch").otherwise("update")
    )


def by_listing(listing: DataFrame, files: DataFrame) -> DataFrame:
    """First stage, from the cheap listing: add, delete, skip, or check (time differs).

    One full outer join on the path answers all three set questions at once. The listing's
    ``size`` is kept if it has one.
    """
    size = [F.col("size")] if "size" in listing.columns else []
    disk = listing.select("file_path", F.col("file_mtime").alias("mtime"), *size)
    known = files.select(F.col("file_path").alias("_path"), F.col("file_hash").alias("old_hash"), F.col("file_mtime").alias("old_mtime"), F.col("chunk_count").alias("old_chunks"))
    both = disk.join(known, F.col("file_path") == F.col("_path"), "full_outer")
    action = classify(F.col("file_path").isNotNull(), F.col("_path").isNotNull(), F.col("mtime") == F.col("old_mtime"), F.lit(False))
    return both.select(F.coalesce("file_path", "_path").alias("file_path"), "mtime", *size, "old_hash", "old_mtime", "old_chunks", F.when(action == "update", "check").otherwise(action).alias("action"))


def stats(actions: DataFrame) -> DataFrame:
    """One row: added, updated, deleted."""
    count = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return actions.agg(count("add").alias("added"), count("update").alias("updated"), count("delete").alias("deleted"))


def ordered(actions: DataFrame, key: str = "file_path") -> DataFrame:
    """``actions`` with their ``place`` from 0 in the order of the key.

    A range sort: only the number of rows of each partition reaches the driver.
    """
    parts = actions.repartitionByRange(key).sortWithinPartitions(key).withColumn("_row", F.monotonically_increasing_id())
    rows = materialise(parts.select("*", F.shiftright("_row", 33).alias("_part"), F.col("_row").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_row"), "ordered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["n"]
    offsets = actions.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
