"""Tables of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task is to have at least.
TASK_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is so small that its files give them too few tasks.

    A file is cut at row groups only, so a table of one row group is one task, however
    much work its rows are. Only a scan under cores x TASK_BYTES is dealt anew; a
    larger one keeps the tasks of its files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * TASK_BYTES else df
