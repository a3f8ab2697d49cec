"""Reading the files that a table names, and writing tables as files.

``with_content`` reads the named files only. They are dealt to tasks by their bytes, and a task, in the order of paths,
reads one file after the other and hands rows on as soon as it holds FLUSH bytes, so a worker's
memory follows the largest file, not the number of files or the folder.

Workers open POSIX paths and ``file:`` ones themselves, and those of schemes that Arrow's file
systems know (hdfs, s3, s3a, gs) through these. Where that isn't possible, Spark's source of binary
files reads the named paths, in the JVM; for more than PATHS of them it scans the folder, and contents are joined
by sort and merge, never broadcast.

Defined cases: a file that has gone has ``found`` false and null contents; a file that can't be read
counts as gone; an empty table gives an empty one; columns ``content``, ``found``, ``file_hash`` and ``text``
are replaced, others pass through; a path that occurs twice is read twice.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import repaired
from lodestar.sources.files import Files, is_local

#: Bytes and files of one task, bytes that a worker holds, and paths that the driver names to Spark's own source.
TASK_BYTES, TASK_FILES, FLUSH, PATHS = 64 << 20, 2_000, 4 << 20, 1_000

_systems: dict = {}


def _posix(path: str) -> str | None:
    """The POSIX path of a bare path or one of ``file:``."""
    if is_local(path):
        return path
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def _system(path: str):
    """(Arrow file system, path on it) of a path with a scheme."""
    import pyarrow.fs

    scheme, _, rest = path.partition("://")
    host = rest.split("/", 1)[0]
    if (scheme, host) not in _systems:
        _systems[scheme, host] = pyarrow.fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}/")[0]
    return _systems[scheme, host], rest if scheme.startswith(("s3", "gs")) else "/" + rest.partition("/")[2]


def workers_can_open(folder: str) -> bool:
    if _posix(folder) is not None:
        return True
    try:
        return _system(folder) is not None
    except Exception:  # no such file system, or no library for it
        return False


def _bytes(path: str) -> bytes | None:
    try:
        if (own := _posix(path)) is not None:
            with open(own, "rb") as f:
                return f.read()
        system, name = _system(path)
        with system.open_input_file(name) as f:
            return f.read()
    except OSError:
        return None


def read_range(path: str, start: int, size: int) -> bytes:
    """So many bytes of a file from ``start`` on, fewer at its end."""
    if (own := _posix(path)) is not None:
        with open(own, "rb") as f:
            f.seek(start)
            return f.read(size)
    system, name = _system(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(size)


def _reader(path: str, read=None):
    """``read`` is an accumulator of the files that were opened."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            names = batch.column(path).to_pylist()
            for k, name in enumerate(names):
                held.append(_bytes(name) if name is not None else None)
                size += len(held[-1] or b"")
                if read is not None:
                    read.add(1)
                if size >= FLUSH or k == len(names) - 1:
                    rows = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary()), pa.array([c is not None for c in held])], [*batch.schema.names, "content", "found"])
                    held, size, first = [], 0, k + 1

    return streamed


def _tasks(files: DataFrame) -> int:
    """How many tasks the files are dealt to, by their bytes where ``size`` tells them."""
    size = F.sum("size") if "size" in files.columns else F.lit(0)
    n, total = files.agg(F.count("*"), F.coalesce(size, F.lit(0)).cast("bigint")).first()
    return max(1, -(-n // TASK_FILES), -(-total // TASK_BYTES))


def _by_spark(files: DataFrame, path: str, folder: str) -> DataFrame:
    spark = files.sparkSession
    source = spark.read.format("binaryFile")
    names = [r[0] for r in files.select(path).distinct().limit(PATHS + 1).collect()]
    if len(names) <= PATHS:
        there = list(filter(Files(spark).exists, names))
        if not there:
            return files.withColumns({"content": F.lit(None).cast("binary"), "found": F.lit(False)})
        whole = source.load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in there])
        read = whole.select(F.col("path").alias("_path"), "content").join(F.broadcast(files), F.col("_path") == F.col(path))
        gone = files.filter(~F.col(path).isin(there))
    else:
        whole = source.option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("_path"), "content")
        read = whole.hint("merge").join(files, F.col("_path") == F.col(path))
        gone = files.join(whole.select(F.col("_path").alias(path)), path, "left_anti")
    return read.select(*files.columns, "content", F.lit(True).alias("found")).unionByName(gone.withColumns({"content": F.lit(None).cast("binary"), "found": F.lit(False)}).select(*files.columns, "content", "found"))


def with_content(files: DataFrame, path: str = "file_path", folder: str | None = None, read=None) -> DataFrame:
    """``files`` with content, file_hash, text and found (false where the file has gone).

    ``folder`` tells where the files are, if their paths have a scheme; ``size`` (bytes), where ``files`` has it, how they are
    dealt to tasks. ``read``, an accumulator, counts the files that workers open.
    """
    plain = files.drop("content", "found", "file_hash", "text")
    if folder is None or workers_can_open(folder):
        schema = T.StructType([*plain.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("found", T.BooleanType())])
        got = plain.repartition(_tasks(plain), path).sortWithinPartitions(path).mapInArrow(_reader(path, read), schema)
    else:
        got = _by_spark(plain, path, folder)
    return got.withColumn("file_hash", F.sha2("content", 256)).withColumn("text", repaired(F.col("content")))


def write_files(rows: DataFrame, folder: str, path: str = "rel_path", content: str = "content", mtime: str | None = None) -> int:
    """Write each row as a file below a POSIX ``folder``, in the tasks that hold the rows; their number.

    A file is written beside its place and moved there, so a task that is run again leaves
    the same file and a reader never sees half of one.
    """
    columns = [F.col(path).alias("p"), F.col(content).cast("binary").alias("c"), (F.col(mtime) if mtime else F.lit(None)).cast("double").alias("m")]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for p, c, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                target = os.path.join(folder, p)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                draft = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{os.getpid()}")
                with open(draft, "wb") as f:
                    f.write(c or b"")
                if m is not None:
                    os.utime(draft, (m, m))
                os.replace(draft, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    os.makedirs(folder, exist_ok=True)
    return rows.select(*columns).mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def bare(spark: SparkSession, folder: str) -> str:
    """A folder of the ``file:`` scheme as a POSIX path, on which links and times are seen; others as they are."""
    return _posix(folder) or folder
