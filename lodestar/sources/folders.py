"""Listing folders of text files; ``contents`` reads them.

The built-in file sources follow symbolic links and skip names that begin with
an underscore, so the listing of a POSIX mount is a data source of its own. Subfolders
are partitions: the driver lists the top, and further down only as far as it
takes to have PARTS of them; executors walk the rest.

A folder with a scheme (hdfs://, s3a://, file://) is listed by Spark's source of
binary files. There are no links there, and names that begin with an underscore are
skipped, as Spark does.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.functions.text import is_indexable
from lodestar.schemas import LISTING
from lodestar.sources.files import Files, is_local

#: Partitions that a listing is to have, where there are so many folders.
PARTS = 64


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        shallow, deep = [], deque([self.root])
        while deep and len(deep) + len(shallow) < PARTS and len(shallow) < PARTS // 2:
            folder = deep.popleft()
            shallow.append(folder)
            try:
                deep.extend(sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")))
            except OSError:  # gone meanwhile
                continue
        return [Folder(p, False) for p in shallow] + [Folder(p, True) for p in deep]

    def read(self, partition: Folder) -> Iterator[tuple]:
        """(file_path, rel_path, file_mtime, size) of regular files; links are neither read nor followed."""
        waiting = [partition.path]
        while waiting:
            try:
                entries = list(os.scandir(waiting.pop()))
            except OSError:  # gone meanwhile
                continue
            for e in entries:
                if e.name.startswith(".") or e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if partition.deep:
                        waiting.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    try:
                        state = e.stat(follow_symlinks=False)
                    except OSError:
                        continue
                    yield e.path, os.path.relpath(e.path, self.root), state.st_mtime, state.st_size


class FolderSource(DataSource):
    """``spark.read.format("lodestar_folder").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "lodestar_folder"

    def schema(self) -> T.StructType:
        return LISTING

    def reader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(os.path.abspath(self.options["path"]))


def list_named(spark: SparkSession, folder: str, paths: DataFrame, ignore_patterns: list[str] = (), ignore_extensions: list[str] = ()) -> DataFrame:
    """Those rows of ``list_folder`` whose paths are among paths(file_path). On a POSIX mount only these are looked at."""
    named = paths.select("file_path").distinct()
    if not is_local(folder):
        return list_folder(spark, folder, ignore_patterns, ignore_extensions).join(named, "file_path", "left_semi")
    if not os.path.isdir(folder):
        raise ValueError(f"not a folder: {folder}")
    top = os.path.abspath(folder).rstrip("/")

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[str, bool] = {}  # whether a folder is a link or below one
        for batch in batches:
            rows = [row for p in batch.column(0).to_pylist() if p and (row := _state(top, p, links))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_path", pa.string()), ("rel_path", pa.string()), ("file_mtime", pa.float64()), ("size", pa.int64())]))

    return named.mapInArrow(looked_at, LISTING).filter(is_indexable(F.col("rel_path"), list(ignore_patterns or ()), list(ignore_extensions or ())))


def _state(top: str, path: str, links: dict[str, bool]) -> dict | None:
    """The listing's row of a regular file that the walk from ``top`` would find under this name."""

    def linked(folder: str) -> bool:
        if folder == top:
            return False
        if folder not in links:
            links[folder] = os.path.islink(folder) or linked(os.path.dirname(folder))
        return links[folder]

    if not path.startswith(top + "/") or os.path.normpath(path) != path or linked(os.path.dirname(path) if os.path.dirname(path) != "/" else top):
        return None
    try:
        state = os.lstat(path)
    except OSError:
        return None
    return {"file_path": path, "rel_path": path[len(top) + 1 :], "file_mtime": state.st_mtime, "size": state.st_size} if stat.S_ISREG(state.st_mode) else None


def list_folder(spark: SparkSession, folder: str, ignore_patterns: list[str] = (), ignore_extensions: list[str] = ()) -> DataFrame:
    """The indexable files of a folder; ValueError if it isn't one."""
    if not is_local(folder):
        if not Files(spark).exists(folder):
            raise ValueError(f"not a folder: {folder}")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        size = F.length(F.lit(Files(spark).qualified(folder).rstrip("/"))) + 2
        listed = found.select(F.col("path").alias("file_path"), F.substring("path", size, F.length("path")).alias("rel_path"), (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"), F.col("length").alias("size"))
    else:
        if not os.path.isdir(folder):
            raise ValueError(f"not a folder: {folder}")
        spark.dataSource.register(FolderSource)
        listed = spark.read.format("lodestar_folder").load(os.path.abspath(folder))
    return listed.filter(is_indexable(F.col("rel_path"), list(ignore_patterns or ()), list(ignore_extensions or ())))
