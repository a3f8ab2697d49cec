"""A folder as a streaming source whose offset is a digest of its listing.

The digest is a sum of hashes of path, time and size of each visible file, so it needs neither order nor memory,
and is the same wherever it is computed. While it stays the same, no batch is made and no Spark job runs. A new digest is a new
offset, and its batch runs the full diff of ``sync``: a digest tells that something has changed, the stored version what.

Exactly once: the stream has an id of its own, kept beside the collection with its checkpoint, and a version's file
names the last batch of each stream that went into it. A batch that is run again, since the driver ended between the
commit of the version and that of the checkpoint, finds itself there and does nothing.

A batch that fails is recorded and tried again: the number of failures is part of the offset, so the next look at the folder
gives another one. Stopping waits for the batch that runs; one that comes after that isn't done, and
is run at the next start. The listing is walked by the source's own process on the driver's machine, one folder
after the other; for folders with a scheme there is the heartbeat of ``watch``.
"""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from lodestar.sources.contents import bare
from lodestar.sources.files import Files
from lodestar.streaming.watch import HISTORY, POLL_SECONDS, Turns

log = logging.getLogger(__name__)
SCHEMA = T.StructType().add("digest", T.StringType()).add("files", T.LongType())


def listing_digest(root: str) -> tuple[str, int]:
    """(digest, number) of the visible regular files below a folder; links aren't followed."""
    total, n, waiting = 0, 0, [root]
    while waiting:
        try:
            entries = os.scandir(waiting.pop())
        except OSError:  # gone meanwhile
            continue
        with entries:
            for e in entries:
                if e.name.startswith(".") or e.is_symlink():
                    continue
                try:
                    if e.is_dir(follow_symlinks=False):
                        waiting.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        state = e.stat(follow_symlinks=False)
                        total += xxhash.xxh3_128_intdigest(f"{os.path.relpath(e.path, root)}\0{state.st_mtime_ns}\0{state.st_size}".encode("utf-8", "surrogateescape"))
                        n += 1
                except OSError:
                    continue
    return f"{total % (1 << 128):032x}", n


class Listed(InputPartition):
    def __init__(self, end: dict):
        super().__init__(0)
        self.end = end


class FolderDigests(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.failures = options["path"], options.get("failures")

    def initialOffset(self) -> dict:
        return {"digest": "", "files": 0, "failures": 0}

    def latestOffset(self) -> dict:
        digest, files = listing_digest(self.root)
        return {"digest": digest, "files": files, "failures": _failures(self.failures)}

    def partitions(self, start: dict, end: dict) -> list[Listed]:
        return [Listed(end)]

    def read(self, partition: Listed) -> Iterator[tuple]:
        yield partition.end["digest"], partition.end["files"]

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are past."""


def _failures(path: str | None) -> int:
    try:
        with open(path or "", encoding="utf-8") as f:
            return int(f.read() or 0)
    except (OSError, ValueError):
        return 0


class FolderStreamSource(DataSource):
    """``spark.readStream.format("lodestar_folder_stream").load(path)``: a row for each digest."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_folder_stream"

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> FolderDigests:
        return FolderDigests(dict(self.options))


class FolderStream:
    """Runs ``sync(stream, batch)`` whenever a folder's listing has changed. ``state`` is the folder
    of the stream's id, checkpoint and failures; starting again is no second stream."""

    def __init__(self, spark: SparkSession, name: str, folder: str, state: str, sync: Callable[[str, int], object], seconds: float = POLL_SECONDS):
        self.spark, self.name, self.folder, self.sync, self.seconds = spark, name, folder, sync, seconds
        self.state, self.files = state, Files(spark)
        self.query: StreamingQuery | None = None
        self.turns = Turns()
        #: What each batch gave, the last HISTORY of them: counts, or {"error": text}.
        self.beats: deque[dict] = deque(maxlen=HISTORY)

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def _id(self) -> str:
        """The stream's id, made at its first start."""
        path = os.path.join(self.state, "stream.json")
        self.files.create(path, json.dumps({"id": uuid.uuid4().hex}))
        return json.loads(self.files.read(path))["id"]

    def start(self) -> None:
        if self.running:
            return
        self.spark.dataSource.register(FolderStreamSource)
        stream = self._id()
        failures = os.path.join(bare(self.spark, self.state), "failures")

        turns = self.turns = Turns()

        def on_batch(_, batch: int) -> None:
            with turns:
                if turns.ending.is_set():
                    raise InterruptedError("the stream has been stopped")
                try:
                    self.beats.append(dict(self.sync(stream, batch) or {}))
                except Exception as e:  # the next look at the folder gives another offset
                    log.exception("synchronising %s failed", self.name)
                    self.beats.append({"error": str(e)})
                    self.files.replace(failures, str(_failures(failures) + 1))

        source = self.spark.readStream.format("lodestar_folder_stream").option("failures", failures).load(self.folder)
        checkpoint = os.path.join(self.state, f"checkpoint-{stream}")
        checkpoint = f"file://{checkpoint}" if checkpoint.startswith("/") else checkpoint
        self.query = source.writeStream.queryName(f"folder_{self.name}_{uuid.uuid4().hex[:8]}").option("checkpointLocation", checkpoint).foreachBatch(on_batch).trigger(processingTime=f"{self.seconds} seconds").start()

    def stop(self, timeout: float | None = None) -> bool:
        """End after the batch that runs; False, and it goes on, if that takes longer than ``timeout``."""
        if self.query is not None:
            if not self.turns.end(timeout):
                return False
            self.query.stop()
            self.query = None
        return True
