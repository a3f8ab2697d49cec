"""The engine's API: collections, synchronisation, search and status."""

from __future__ import annotations

import os
import threading
import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import sparse
from lodestar.operators import quantised, stats
from lodestar.operators.catalog import Catalog
from lodestar.operators.embedding import HashingEmbedder
from lodestar.operators.store import ConcurrentWrite, Store
from lodestar.operators.sync import Settings, sync, sync_apart
from lodestar.operators.tasks import TaskQueue, Tasks
from lodestar.plans import retrieval
from lodestar.schemas import FILES
from lodestar.sources.files import is_local
from lodestar.streaming.folder import FolderStream
from lodestar.streaming.watch import POLL_SECONDS, Watcher

SPARSE_MODEL = "tf-saturation"
KEEP_SECONDS = 3600.0


class Busy(RuntimeError):
    """A collection can't be removed while something writes to it."""


class Engine:
    """Collections below ``home``, which every executor must reach."""

    def __init__(self, spark: SparkSession, home: str, settings: Settings | None = None, poll_seconds: float = POLL_SECONDS):
        self.spark, self.home = spark, home
        self.settings = settings or Settings(HashingEmbedder())
        self.catalog = Catalog(spark, home)
        self.poll_seconds = poll_seconds
        self.watchers: dict[str, FolderStream | Watcher] = {}
        #: Versions that are kept after another has been committed: two, and those of so many seconds.
        self.keep_seconds = KEEP_SECONDS
        self.queue = TaskQueue(Tasks(Store(spark, home, "tasks")), self._index)
        self._busy: Counter[str] = Counter()
        self._turns: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self._idle = threading.Condition()

    def store(self, name: str) -> Store:
        return Store(self.spark, os.path.join(self.home, "collections"), name)

    @contextmanager
    def _working(self, name: str) -> Iterator[None]:
        """While something writes to a collection, it can't be removed. Writers of this
        engine take turns; against those of others a commit is tried again by ``_again``."""
        with self._idle:
            if self._busy[name] < 0:
                raise Busy(f"{name} is being removed")
            self._busy[name] += 1
        tag = f"collection-{name}"
        self.spark.addTag(tag)
        try:
            with self._turns[name]:
                yield
        finally:
            self.spark.removeTag(tag)
            with self._idle:
                self._busy[name] -= 1
                self._idle.notify_all()

    def _again(self, work: Callable[[], dict[str, int]], times: int = 3) -> dict[str, int]:
        """Repeat what another engine's commit has overtaken; it compares anew each time."""
        for _ in range(times - 1):
            with suppress(ConcurrentWrite):
                return work()
        return work()

    def _run(self, name: str, rebuild: bool = False, **options) -> dict[str, int]:
        entry = self.catalog.get(name)
        with self._working(name):
            had = rebuild and self.store(name).model() is not None
            counts = self._again(lambda: sync_apart(self.spark, self.store(name), entry["folder_path"], self.settings, entry["ignore_patterns"], entry["ignore_extensions"], rebuild=rebuild, **options))
            if had:
                self._again(lambda: self._fit(name, None))
            self._tidy(name, counts)
            return counts

    def _tidy(self, name: str, counts: dict[str, int]) -> None:
        """Merge segments that are due and remove what no version of late needs, if anything was written. An
        index whose collection has grown to twice its size is fitted anew, with more cells."""
        store = self.store(name)
        if any(counts.values()) and (model := store.model()) is not None and sum(s["rows"] for s in store.segments("points")) > 2 * max(model["points"], 1):
            self._again(lambda: self._fit(name, None))
        if any(counts.values()) or len(store._numbers()) > 2:
            store.compact()
            store.vacuum(2, self.keep_seconds)

    def _sync(self, name: str, rebuild: bool = False) -> dict[str, int]:
        return self._run(name, rebuild=rebuild)

    def _index(self, name: str, paths: list[str]) -> dict[str, int]:
        """Handler of tasks: these files only. A file that has gone loses its points."""
        entry = self.catalog.get(name)
        with self._working(name):
            only = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
            counts = self._again(lambda: sync(self.spark, self.store(name), entry["folder_path"], self.settings, entry["ignore_patterns"], entry["ignore_extensions"], only=only))
            self._tidy(name, counts)
            return counts

    def enqueue(self, name: str, paths: list[str]) -> int:
        """Have files indexed by a worker; the number accepted."""
        self.catalog.get(name)
        return self.queue.enqueue(name, paths)

    def tasks(self, name: str) -> dict:
        """pending, queued and in_progress tasks of a collection."""
        self.catalog.get(name)
        return self.queue.status(name)

    def cancel(self, name: str) -> dict:
        self.catalog.get(name)
        return self.queue.cancel(name)

    def wait(self, name: str, timeout: float = 30.0) -> bool:
        """Wait until a collection has no pending task; False if time runs out."""
        self.catalog.get(name)
        return self.queue.wait_done(name, timeout)

    def restore(self) -> dict[str, dict]:
        """Bring all collections up to date; all anew if a model has changed. One that
        fails is reported and doesn't stop the others."""
        changed, _, _ = self.catalog.model_changed(self.settings.embedder.name, SPARSE_MODEL)
        out: dict[str, dict] = {}
        for name in self.catalog.all():
            try:
                out[name] = self._sync(name, rebuild=changed)
            except Exception as e:  # reported to the caller by collection
                out[name] = {"error": str(e)}
        if not any("error" in v for v in out.values()):
            self.catalog.save_signature(self.settings.embedder.name, SPARSE_MODEL)
        return out

    def add(self, name: str, folder: str, ignore_patterns: list[str] | None = None, ignore_extensions: list[str] | None = None, watch: bool = False) -> dict[str, int]:
        """Register and index a folder; leaves no trace if that fails."""
        folder = os.path.abspath(os.path.expanduser(folder)) if is_local(folder) else folder
        self.catalog.register(name, folder, ignore_patterns, ignore_extensions)
        try:
            counts = self._sync(name)
            if watch:
                self.watch(name)
            return counts
        except BaseException:
            self._forget(name)
            raise

    def clean(self, name: str) -> None:
        """Merge all segments of a collection and remove all versions but the last."""
        self.catalog.get(name)
        with self._working(name):
            self.store(name).compact(whole=True)
            self.store(name).vacuum(1)

    def update(self, name: str, **rules) -> dict:
        return self.catalog.update(name, **rules)

    def _forget(self, name: str) -> None:
        if (watcher := self.watchers.pop(name, None)) is not None:
            watcher.stop()
        self.store(name).drop()
        self.catalog.unregister(name)

    def remove(self, name: str, timeout: float = 30.0) -> None:
        """Stop watching, cancel waiting tasks, wait for what runs, and drop the collection.

        If it is still busy after ``timeout``, ``Busy`` is raised and the collection stays,
        watched as before. Nothing can begin to write to it meanwhile.
        """
        self.catalog.get(name)
        watched = name in self.watchers and self.watchers[name].running
        end = time.monotonic() + timeout
        if watched:
            self.watchers[name].stop(timeout)
        self.queue.cancel(name)
        with self._idle:
            free = self._idle.wait_for(lambda: self._busy[name] == 0, max(0.0, end - time.monotonic()))
            if free:
                self._busy[name] = -1
        try:
            if not free:
                raise Busy(f"{name} still has work in progress")
            self._forget(name)
        except BaseException:
            if watched:
                self.watch(name)
            raise
        finally:
            if free:
                with self._idle:
                    self._busy[name] = 0

    def sync(self, name: str) -> dict[str, int]:
        return self._sync(name)

    def rebuild(self, name: str) -> dict[str, int]:
        return self._sync(name, rebuild=True)

    def watch(self, name: str) -> FolderStream | Watcher:
        """Keep a collection in step with its folder: by the listing's digest, or for folders that the
        driver can't walk by the diff on each beat."""
        folder = self.catalog.get(name)["folder_path"]
        if is_local(folder):
            made = lambda: FolderStream(self.spark, name, folder, os.path.join(self.home, "collections", name, "stream"), lambda stream, batch: self._run(name, batch=(stream, batch)), self.poll_seconds)
        else:
            made = lambda: Watcher(self.spark, name, lambda: self._sync(name), self.poll_seconds)
        watcher = self.watchers.get(name) or self.watchers.setdefault(name, made())
        watcher.start()
        return watcher

    def search_batch(self, name: str, queries: DataFrame, **options) -> DataFrame:
        """Ranked results for queries(query_id, text); see ``retrieval.search``. With
        ``probes`` the dense leg searches that many cells of the index that ``build_index`` made."""
        self.catalog.get(name)
        store = self.store(name)
        version = store.version()
        if "probes" in options:
            options["index"] = self.index(name, version)
        options.setdefault("few_terms", 1000)
        options.setdefault("stop_words", tuple(self.settings.stop_words))
        embedded = queries.withColumn("dense", self.settings.embedder.column(F.col("text"), is_query=True))
        return retrieval.search(store.read("points", version), sparse.weighted(store.read("postings", version)), embedded, **options)

    def index(self, name: str, version: int) -> quantised.Index:
        """The approximate index of a version; ValueError if there is none."""
        store = self.store(name)
        if (model := store.model(version)) is None:
            raise ValueError(f"there is no index of {name}")
        return quantised.Index(store.read("codes", version), quantised.Model.from_dict(model))

    def build_index(self, name: str, cells: int | None = None) -> None:
        """Fit an approximate index and commit it; later commits keep it in step with the points."""
        self.catalog.get(name)
        with self._working(name):
            self._again(lambda: self._fit(name, cells))

    def _fit(self, name: str, cells: int | None) -> dict[str, int]:
        store = self.store(name)
        version = store.version()
        points = store.read("points", version)
        model = quantised.fit(points, cells)
        store.commit(version, model.to_dict(), codes=quantised.encoded(points, model))
        return {}

    def search(self, name: str, query: str, **options) -> list[dict]:
        one = self.spark.createDataFrame([(0, query)], "query_id bigint, text string")
        rows = self.search_batch(name, one, **options).orderBy("rank").collect()
        return [{k: r[k] for k in ("text", "source_file", "chunk_index", "total_chunks", "score")} for r in rows]

    def files(self) -> DataFrame:
        """File states of all collections, with the collection's name."""
        out = self.spark.createDataFrame([], FILES).withColumn("collection", F.lit(""))
        for name in self.catalog.all():
            out = out.unionByName(self.store(name).read("files").withColumn("collection", F.lit(name)))
        return out

    def status(self, name: str) -> DataFrame:
        entry = self.catalog.get(name)
        watching = name in self.watchers and self.watchers[name].running
        return stats.status(self.store(name).read("files")).withColumns({"name": F.lit(name), "folder_path": F.lit(entry["folder_path"]), "watching": F.lit(watching)})

    def health(self, tasks: DataFrame | None = None) -> DataFrame:
        tasks = self.queue.table(self.spark) if tasks is None else tasks
        return stats.health(self.catalog.table(), self.files(), tasks)
