"""Polling a folder as a stream.

A file stream reports neither changes nor deletions, so the stream is only a
heartbeat: each beat runs the full diff of ``sync``. The stored version is the
state, so a restarted stream goes on where the last commit left off, and its
checkpoint, in the shared folder, need not be kept. A beat that fails is
recorded, and the next one tries again. Stopping waits for the beat that runs: an interrupted one
would fail, and its files be tried part by part.
"""

from __future__ import annotations

import logging
import threading
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestar.sources.files import Files
from lodestar.storage import shared_dir

log = logging.getLogger(__name__)
POLL_SECONDS, HISTORY = 900, 100


class Turns:
    """What a stream's batches and its end take turns by."""

    def __init__(self):
        self.ending, self._lock = threading.Event(), threading.RLock()

    def __enter__(self) -> None:
        self._lock.acquire()

    def __exit__(self, *_) -> None:
        self._lock.release()

    def end(self, timeout: float | None) -> bool:
        """Whether the batch that runs has ended within ``timeout``. If so, those that follow find ``ending`` set, and else nothing has changed."""
        self.ending.set()
        if not self._lock.acquire(timeout=-1 if timeout is None else timeout):
            self.ending.clear()
            return False
        self._lock.release()
        return True


class Watcher:
    """Runs ``sync()`` of a collection on each beat; starting again is no second watcher."""

    def __init__(self, spark: SparkSession, name: str, sync: Callable[[], object], seconds: float = POLL_SECONDS):
        self.spark, self.name, self.sync, self.seconds = spark, name, sync, seconds
        self.query: StreamingQuery | None = None
        self.turns = Turns()
        #: What each beat gave, the last HISTORY of them: counts, or {"error": text}.
        self.beats: deque[dict] = deque(maxlen=HISTORY)

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self) -> None:
        if self.running:
            return
        beat = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        first = [True]
        turns = self.turns = Turns()

        def on_beat(_, __) -> None:
            if first:  # the first beat comes at once, and the start has synced already
                first.clear()
                return
            with turns:
                if turns.ending.is_set():
                    return
                try:
                    self.beats.append(dict(self.sync() or {}))
                except Exception as e:  # the next beat tries again
                    log.exception("synchronising %s failed", self.name)
                    self.beats.append({"error": str(e)})

        self.where = where = f"{shared_dir(self.spark)}/watch-{self.name}-{uuid.uuid4().hex}"
        self.query = beat.writeStream.queryName(f"watch_{self.name}_{uuid.uuid4().hex[:8]}").option("checkpointLocation", where).foreachBatch(on_beat).trigger(processingTime=f"{self.seconds} seconds").start()

    def stop(self, timeout: float | None = None) -> bool:
        """End after the beat that runs; False, and it goes on, if that takes longer than ``timeout``."""
        if self.query is not None:
            if not self.turns.end(timeout):
                return False
            self.query.stop()
            self.query = None
            Files(self.spark).delete(self.where)
        return True
