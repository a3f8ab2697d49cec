"""Tables written to the shared checkpoint folder, to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a file of a table of known size is to have.
ROWS_IN_FILE = 50_000
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and all of Spark is
    one process (unit tests) a temporary folder is taken.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        where = getattr(spark, "_lodestar_dir", None) or "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark._lodestar_dir = where
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, rows: int | None = None, heavy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the table survives the loss
    of executors, and a plan above it never recomputes what is below. It is
    deleted by ``discard``, or when the driver ends.

    ``rows`` is a bound of its rows, so that a small table isn't written as very many
    files; there are as many as before where the bound is large. With ``heavy`` the last
    stage keeps its tasks, and their results are exchanged before they are written.
    """
    spark = df.sparkSession
    if rows is not None:
        files = max(1, -(-rows // ROWS_IN_FILE))
        if not heavy:
            df = df.coalesce(files)
        elif files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` gave and no plan reads any more."""
    for table in tables:
        path = getattr(table, "_lodestar_path", None)
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has already ended
            return
