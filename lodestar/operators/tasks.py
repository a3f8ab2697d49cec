"""Indexing tasks as a stored table, shared by the workers of any number of drivers.

A task is a row of the table ``tasks`` of a store: a file of a collection, who holds it and until when, and the error it ended
with. Each step is one commit of the store, and of two that meet one is done again on what the other
left, so a task is held by one worker. A lease that has run out makes a task free again: what a driver
had claimed when it ended is done by another. Nothing about tasks lives in a driver's memory.

Accepting, claiming and ending are set operations on the table; the driver gets the paths of
one batch. If a batch fails, its halves are tried, so that an error stays with its file.

Defined cases: a task that is waiting or held isn't accepted again; one that ended with an error is; of a task asked for
twice one is accepted; what a worker whose lease another has taken over reports is passed over; cancelling takes waiting
tasks out, held ones go on and are counted.
"""

from __future__ import annotations

import logging
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.store import ConcurrentWrite, Store
from lodestar.schemas import LEASES

log = logging.getLogger(__name__)
BATCH, LEASE_SECONDS, POLL = 10_000, 900.0, 0.5


def _key(collection: str | Column, path: str | Column) -> Column:
    return F.concat_ws("\0", collection, path)


def waiting(now: float | Column) -> Column:
    """Whether a task of the table may be claimed."""
    return F.col("error").isNull() & (F.col("worker").isNull() | (F.col("until") <= now))


def held(now: float | Column) -> Column:
    return F.col("error").isNull() & F.col("worker").isNotNull() & (F.col("until") > now)


def states(events: DataFrame, now: float | Column, seconds: float = LEASE_SECONDS) -> DataFrame:
    """(task, state, at) of each task after its events(task, kind, at, place): its last event decides, in the order of ``place``.

    ``enqueue`` leaves it waiting, ``claim`` held, or waiting again once ``seconds`` have passed, ``finish`` and
    ``fail`` done and failed. The fold is one partial aggregation, so a task of very many events is no large group.
    """
    last = events.groupBy("task").agg(F.max_by(F.struct("kind", "at"), "place").alias("e"))
    state = (
        F.when(F.col("e.kind") == "enqueue", "waiting").when((F.col("e.kind") == "claim") & (F.col("e.at") + seconds > now), "held")
        .when(F.col("e.kind") == "claim", "waiting").when(F.col("e.kind") == "fail", "failed").otherwise("done")
    )
    return last.select("task", state.alias("state"), F.col("e.at").alias("at"))


class Tasks:
    """The table of tasks in a store."""

    def __init__(self, store: Store, seconds: float = LEASE_SECONDS):
        self.store, self.spark, self.seconds = store, store.spark, seconds

    def read(self) -> DataFrame:
        return self.store.read("tasks")

    def _commit(self, step: Callable[[DataFrame], tuple[DataFrame, DataFrame, object]], times: int = 50) -> object:
        """``step`` gives the rows that go (their tasks), those that come, and the answer; nothing is written without rows."""
        for _ in range(times):
            base = self.store.version()
            gone, come, answer = step(self.store.read("tasks", base))
            if answer is None:
                return None
            try:
                self.store.change(base, tasks=(gone.select("task"), come))
                self._tidy()
                return answer
            except ConcurrentWrite:
                time.sleep(random.random() / 4)
        raise ConcurrentWrite("the tasks are being changed by too many workers")

    def _tidy(self) -> None:
        if len(self.store.segments("tasks")) >= self.store.fan:
            self.store.compact()
            self.store.vacuum(2, 60.0)

    def enqueue(self, new: DataFrame) -> int:
        """The number of new (collection, file_path) that are accepted."""
        now = time.time()

        def step(tasks: DataFrame):
            rows = new.select("collection", "file_path").distinct().withColumn("task", _key("collection", "file_path"))
            fresh = rows.join(tasks.filter(F.col("error").isNull()), "task", "left_anti")
            n = fresh.count()
            made = fresh.select("task", "collection", "file_path", F.lit(None).cast("string").alias("worker"), F.lit(0.0).alias("until"), F.lit(None).cast("string").alias("error"), F.lit(now).alias("at"))
            return fresh, made, n or None

        return self._commit(step) or 0

    def claim(self, worker: str, most: int = BATCH) -> tuple[str, list[str]] | None:
        """(collection, paths) of free tasks of the collection that has waited longest, held by ``worker`` from now on."""

        def step(tasks: DataFrame):
            now = time.time()
            free = tasks.filter(waiting(now))
            first = free.orderBy("at", "collection").limit(1).collect()
            if not first:
                return free, free, None
            name = first[0]["collection"]
            rows = free.filter(F.col("collection") == name).orderBy("at", "file_path").limit(most).collect()
            mine = self.spark.createDataFrame([(r.task, r.collection, r.file_path, worker, now + self.seconds, None, r.at) for r in rows], LEASES)
            return mine, mine, (name, [r.file_path for r in rows])

        return self._commit(step)

    def finish(self, worker: str, collection: str, paths: list[str], errors: dict[str, str] | None = None) -> int:
        """End tasks that ``worker`` still holds; those with an error stay, with it. How many there were."""
        errors = errors or {}
        ended = self.spark.createDataFrame([(p, errors.get(p)) for p in paths], "file_path string, said string")

        def step(tasks: DataFrame):
            mine = tasks.filter((F.col("collection") == collection) & (F.col("worker") == worker) & F.col("error").isNull()).join(F.broadcast(ended), "file_path")
            n = mine.count()
            failed = mine.filter("said IS NOT NULL").select("task", "collection", "file_path", F.lit(None).cast("string").alias("worker"), F.lit(0.0).alias("until"), F.col("said").alias("error"), "at")
            return mine, failed, n or None

        return self._commit(step) or 0

    def cancel(self, collection: str) -> dict:
        """Take a collection's waiting tasks out, and forget its errors."""
        now = time.time()

        def step(tasks: DataFrame):
            mine = tasks.filter(F.col("collection") == collection)
            free = mine.filter(~held(now))
            n = mine.agg(F.count_if(waiting(now)), F.count_if(held(now)), F.count("*")).first()
            counts.update(queued_removed=n[0], in_progress_tasks=n[1])
            return free, free.limit(0), True if n[2] > n[1] else None

        counts = {"collection": collection, "queued_removed": 0, "in_progress_tasks": 0}
        if self.store.version():
            self._commit(step)
        return counts

    def pending(self, now: float | None = None) -> DataFrame:
        """The pending tasks as (collection, file_path, in_progress)."""
        now = time.time() if now is None else now
        return self.read().filter("error IS NULL").select("collection", "file_path", held(now).alias("in_progress"))

    def failed(self) -> dict[tuple[str, str], str]:
        """The error of each file whose last task failed."""
        return {(r.collection, r.file_path): r.error for r in self.read().filter("error IS NOT NULL").collect()}


class TaskQueue:
    """Workers of this driver on a table of tasks. ``handle(collection, paths)`` indexes files. A worker
    ends when no task is pending; ``enqueue`` and ``start`` make new ones."""

    def __init__(self, tasks: Tasks, handle: Callable[[str, list[str]], object], workers: int = 1):
        self.tasks, self.handle, self.wanted = tasks, handle, max(1, workers)
        self.workers: list[threading.Thread] = []
        self._lock, self._stop = threading.Lock(), threading.Event()

    @property
    def failed(self) -> dict[tuple[str, str], str]:
        return self.tasks.failed()

    def start(self) -> None:
        """Start the workers that are missing; they also do what other drivers have enqueued or left behind."""
        with self._lock:
            self._stop.clear()
            self.workers = [w for w in self.workers if w.is_alive()]
            for _ in range(len(self.workers), self.wanted):
                name = f"{uuid.uuid4().hex[:12]}"
                worker = threading.Thread(target=self._work, args=(name,), name=f"tasks-{name}", daemon=True)
                worker.start()
                self.workers.append(worker)

    def stop(self) -> None:
        """No worker begins another batch."""
        self._stop.set()

    def _work(self, name: str) -> None:
        seen, later = -1, 0.0
        while not self._stop.is_set():
            try:
                version = self.tasks.store.version()
                if version == seen and time.time() < later:  # nothing new, and no lease can have run out
                    self._stop.wait(POLL)
                    continue
                taken = self.tasks.claim(name)
                if taken is None:
                    left, until = self.tasks.read().filter("error IS NULL").agg(F.count("*"), F.min("until")).first()
                    if left:  # others hold tasks, until the first of these leases ends at least
                        seen, later = version, max(until, time.time() + POLL)
                        continue
                    with self._lock:  # ``start`` makes another worker when there is something to do
                        if self.tasks.store.version() == version:
                            self.workers.remove(threading.current_thread())
                            return
                    continue
                errors: dict[str, str] = {}
                self._try(*taken, errors)
                self.tasks.finish(name, *taken, errors)
            except Exception:  # the table can't be reached: the lease runs out and the tasks come again
                log.exception("a worker goes on after an error")
                self._stop.wait(POLL)

    def _try(self, collection: str, paths: list[str], errors: dict[str, str]) -> None:
        try:
            self.handle(collection, paths)
        except Exception as e:
            if len(paths) > 1:
                for half in (paths[: len(paths) // 2], paths[len(paths) // 2 :]):
                    self._try(collection, half, errors)
            else:
                errors[paths[0]] = str(e)
                log.exception("indexing %s failed", paths[0])

    def enqueue(self, collection: str, paths: Iterable[str]) -> int:
        """How many of the tasks are accepted; one that is pending isn't."""
        new = self.tasks.spark.createDataFrame([(collection, p) for p in paths], "collection string, file_path string")
        accepted = self.tasks.enqueue(new)
        self.start()
        return accepted

    def status(self, collection: str) -> dict:
        n, running = self.tasks.pending().filter(F.col("collection") == collection).agg(F.count("*"), F.count_if("in_progress")).first()
        return {"collection": collection, "pending_tasks": n, "queued_tasks": n - running, "in_progress_tasks": running, "worker_alive": any(w.is_alive() for w in self.workers)}

    def cancel(self, collection: str) -> dict:
        return self.tasks.cancel(collection)

    def _wait(self, collection: str, what: str, timeout: float) -> bool:
        end = time.monotonic() + timeout
        while self.status(collection)[what]:
            if time.monotonic() >= end:
                return False
            time.sleep(POLL)
        return True

    def wait_idle(self, collection: str, timeout: float = 30.0) -> bool:
        """Wait until none of a collection's tasks is held; False if one still is."""
        return self._wait(collection, "in_progress_tasks", timeout)

    def wait_done(self, collection: str, timeout: float = 30.0) -> bool:
        """Wait until none of a collection's tasks is pending."""
        return self._wait(collection, "pending_tasks", timeout)

    def table(self, spark: SparkSession) -> DataFrame:
        return self.tasks.pending()
