"""Keeping a collection in step with its folder."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import sparse
from lodestar.functions.text import embed_input, point_id, stem
from lodestar.operators import chunking, diff, quantised
from lodestar.operators.store import ConcurrentWrite, Store
from lodestar.sources.contents import with_content
from lodestar.sources.folders import list_folder, list_named
from lodestar.storage import discard, materialise

log = logging.getLogger(__name__)


@dataclass
class Settings:
    embedder: object
    tokenizer_file: str | None = None
    #: Words that the sparse index leaves out.
    stop_words: tuple[str, ...] = sparse.STOP_WORDS
    #: Hash files also where the time is the same.
    force_hash: bool = False
    #: An accumulator of Spark's, which counts the files that are read.
    read: object = None


def actions(listing: DataFrame, files: DataFrame, settings: Settings, folder: str | None = None) -> DataFrame:
    """(file_path, action, mtime, size, file_hash, old_chunks) of every path, written once; ``discard`` it.

    Only files that are new or whose time differs are read. One that has gone
    since the listing counts as deleted if it was indexed, and else as skipped.
    """
    first = diff.by_listing(listing, files)
    if settings.force_hash:
        first = first.withColumn("action", F.when((F.col("action") == "skip"), "check").otherwise(F.col("action")))
    first = materialise(first, "listed")  # the listing isn't walked again for each use
    reads = with_content(first.filter(F.col("action").isin("add", "check")), folder=folder, read=settings.read).drop("content", "text")
    settled = (
        F.when(~F.col("found"), F.when(F.col("action") == "add", "skip").otherwise("delete"))
        .when(F.col("action") == "add", "add")
        .when(F.col("file_hash") == F.col("old_hash"), F.when(F.col("mtime") == F.col("old_mtime"), "skip").otherwise("touch"))
        .otherwise("update")
    )
    columns = ("file_path", "action", "mtime", "size", "file_hash", "old_chunks")
    unread = first.filter(~F.col("action").isin("add", "check")).withColumn("file_hash", F.col("old_hash"))
    try:
        return materialise(reads.withColumn("action", settled).select(*columns).unionByName(unread.select(*columns)), "actions")
    finally:
        discard(first)


def points_of(files: DataFrame, collection: str, settings: Settings, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Points of files(file_path, text): chunked, titled, with ids and vectors. With ``read`` files come
    without texts, and it reads them."""
    texts = (lambda paths: read(paths).select("file_path", "text")) if read else None
    cut = chunking.chunk_files(files if read else files.select("file_path", "text"), tokenizer_file=settings.tokenizer_file, read=texts)
    titled = cut.withColumnRenamed("file_path", "source_file").withColumn("title", stem(F.col("source_file")))
    return titled.select(
        point_id(F.lit(collection), F.col("source_file"), F.col("chunk_index")).alias("id"), "source_file", "chunk_index", "total_chunks", "title", "text",
        settings.embedder.column(embed_input(F.col("title"), F.col("text"))).alias("dense"))


def sync(spark: SparkSession, store: Store, folder: str, settings: Settings, ignore_patterns: list[str] = (), ignore_extensions: list[str] = (), rebuild: bool = False, only: DataFrame | None = None, part: tuple[int, int] | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
    """Read version N, write version N + 1; {added, updated, deleted}.

    Nothing is written if nothing changed, and else the rows of changed files only.
    Files that become blank lose their points, and are recorded with 0 chunks, so that
    they aren't tried again. ``only`` (file_path) restricts all this to some files,
    ``part`` (n, k) to a hash's share of them. The contents are read where they are
    compared and again where they are cut, and are never kept. A ``batch`` (stream, number) that a
    version holds already does nothing.
    """
    if batch is not None and store.batch(batch[0]) >= batch[1]:
        return {"added": 0, "updated": 0, "deleted": 0}
    listing = list_folder(spark, folder, ignore_patterns, ignore_extensions) if only is None else list_named(spark, folder, only, ignore_patterns, ignore_extensions)
    base = store.version()
    files = store.read("files", 0 if rebuild else base)
    if only is not None:
        files = files.join(only.select("file_path").distinct(), "file_path", "left_semi")
    if part is not None:
        listing, files = (df.filter(F.pmod(F.xxhash64("file_path"), F.lit(part[0])) == part[1]) for df in (listing, files))
    found = actions(listing, files, settings, folder)
    counts = {r["action"]: r["count"] for r in found.groupBy("action").count().collect()}
    if base and not rebuild and not set(counts) - {"skip"}:
        discard(found)
        return {"added": 0, "updated": 0, "deleted": 0}
    try:
        _write(store, base, files, found, folder, settings, whole=not base or (rebuild and only is None and part is None), batch=batch if part is None else None)
    except ConcurrentWrite:
        raise
    except Exception as e:
        raise PartFailed(counts.get("add", 0) + counts.get("update", 0)) from e
    finally:
        discard(found)
    return {"added": counts.get("add", 0), "updated": counts.get("update", 0), "deleted": counts.get("delete", 0)}


class PartFailed(RuntimeError):
    """Some of the changed files couldn't be indexed."""

    def __init__(self, changed: int):
        super().__init__(f"one of {changed} changed files failed")
        self.changed = changed


def _write(store: Store, base: int, files: DataFrame, found: DataFrame, folder: str, settings: Settings, whole: bool, batch: tuple[str, int] | None = None) -> None:
    """The version after ``base``, from the files' states in it and the actions found."""
    now = time.time()
    changed = found.filter(F.col("action").isin("add", "update"))
    new_points = points_of(changed.select("file_path", "size"), store.name, settings, lambda paths: with_content(paths, folder=folder, read=settings.read))
    # all else is made of the points that the store has just written, so they are on disk once
    postings = lambda points: sparse.stored(points, keep=("source_file",), stop_words=settings.stop_words)

    def states(points: DataFrame) -> DataFrame:
        n = points.groupBy(F.col("source_file").alias("file_path")).agg(F.count("*").alias("n"))
        return changed.join(n, "file_path", "left").select("file_path", "file_hash", F.col("mtime").alias("file_mtime"), F.coalesce("n", F.lit(0)).cast("int").alias("chunk_count"), F.lit(now).alias("last_indexed_at"))

    model = store.model(base)
    dealt = ("points", "postings")
    if whole:  # an index is fitted anew afterwards, by who had it made
        store.commit(base, batch=batch, dealt=dealt, points=new_points, postings=postings, files=states)
    else:
        touched = files.join(found.filter(F.col("action") == "touch").select("file_path", F.col("mtime").alias("_mtime")), "file_path").withColumn("file_mtime", F.col("_mtime")).select(*files.columns)
        left = found.filter(F.col("action").isin("add", "update", "delete")).select("file_path")
        noted = found.filter(F.col("action") != "skip").select("file_path")
        codes = {"codes": (left, lambda points: quantised.encoded(points, quantised.Model.from_dict(model)))} if model else {}
        store.change(base, batch, dealt, points=(left, new_points), postings=(left, postings), files=(noted, lambda points: states(points).unionByName(touched)), **codes)


def sync_apart(*args, most_bits: int = 12, **kwargs) -> dict[str, int]:
    """``sync``, of which an error stays with the files it comes from.

    Where a part of the files can't be synchronised, its halves by a hash of the path are
    tried, down to a single changed file or one of 2 ** ``most_bits`` parts. ``failed`` counts the parts left out; it is
    absent if all went well. A folder that is missing and a concurrent writer are
    errors of the whole.
    """

    def tried(n: int, k: int) -> dict[str, int]:
        try:
            return sync(*args, **kwargs, part=(n, k) if n > 1 else None)
        except (ValueError, ConcurrentWrite):
            raise
        except Exception as e:
            log.warning("part %d of %d of the folder failed: %s", k, n, e.__cause__ or e)
            if n >= 1 << most_bits or getattr(e, "changed", 2) <= 1:
                return {"added": 0, "updated": 0, "deleted": 0, "failed": 1}
            a, b = tried(2 * n, k), tried(2 * n, k + n)
            return {c: a.get(c, 0) + b.get(c, 0) for c in {**a, **b}}

    return tried(1, 0)
