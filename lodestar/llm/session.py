"""Reading tables, and the bounds of the batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: a worker's memory follows these, not the partition.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
