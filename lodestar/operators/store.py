"""Versioned collections, merged on read: points, postings, codes, file states and tasks.

A version is a small file that names, for each table, its segments in the order of their making. A segment
holds new rows and marks, the paths of the files whose earlier rows have gone. A row
counts unless a later segment marks its file. So a change writes what has changed and no more,
and its cost doesn't depend on the collection's size.

``compact`` merges the newest segments when there are FAN of about one size, so a row is written
anew a number of times that grows with the logarithm of the collection; marks go when they are merged with the
oldest segment. Within a segment rows are dealt to files by their bytes and sorted; rows that are dealt already are
written by the tasks that hold them, without an exchange. Points are written first, and what depends on them
is made of the written ones, so that no other copy of them is on disk.

Segments never change. Points and file states of a version can't diverge, a
reader keeps the version it began with, also while segments are merged, and a failed write leaves
the last version in place. The file of a version can be created once only, and
each attempt writes to folders of its own, so of two writers of one version the
second fails; a merge that another commit has overtaken is put on top of it. A version that can't be
read (its file is broken, or a segment has gone or isn't as long as it was) is
passed over, and the last good one counts.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.schemas import CODES, FILES, LEASES, POINTS, POSTINGS
from lodestar.sources.files import Files

TABLES: dict[str, T.StructType] = {"points": POINTS, "postings": POSTINGS, "files": FILES, "codes": CODES, "tasks": LEASES}
#: The column of a table that tells the file a row belongs to, and the order of rows in a file of a segment; the first column deals rows to them.
KEYS = {"points": "source_file", "postings": "source_file", "files": "file_path", "codes": "source_file", "tasks": "task"}
ORDER = {"points": ("source_file", "chunk_index"), "postings": ("source_file",), "files": ("file_path",), "codes": ("cell", "id"), "tasks": ("task",)}
#: Segments of about one size that are merged, bytes of the smallest size, and marks that readers broadcast at most.
FAN, SMALL, MARKS = 8, 32 << 20, 100_000
#: How segments are written: they are read far more often, and two versions are on disk while one is built anew.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": 9}
#: The form of the tables. Versions with postings of another form are passed over, so their files are indexed anew.
FORM = 2
#: Rows of a table, or what makes them of the points that are written with them.
Rows = DataFrame | Callable[[DataFrame], DataFrame]


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version this one was based on."""


def due(segments: list[dict], fan: int = FAN) -> int | None:
    """Where the run of newest segments begins that is to be merged; None if there is none.

    A run has ``fan`` segments of one size, and newer ones of smaller sizes. All are merged when there are more
    marks than readers broadcast, if the table is small or these are half as many as its rows: a merge writes all of it anew beside the old one.
    """
    level = [0 if s["bytes"] < SMALL else 1 + int(math.log(s["bytes"] / SMALL, fan)) for s in segments]
    marks = sum(s["marks"] for s in segments)
    if len(segments) > 1 and marks > MARKS and (sum(s["bytes"] for s in segments) < SMALL or 2 * marks > sum(s["rows"] for s in segments)):
        return 0
    for top in sorted(set(level)):
        run = next((k for k in range(len(level), 0, -1) if level[k - 1] > top), 0)
        if level[run:].count(top) >= fan:
            return run
    return None


class Store:
    """One collection's tables below ``root/name``, a path of any file system of the session."""

    def __init__(self, spark: SparkSession, root: str, name: str, fan: int = FAN):
        self.spark, self.name, self.fan = spark, name, fan
        self.path = os.path.join(root, name)
        self.files = Files(spark)

    # ---- versions

    def _numbers(self) -> list[int]:
        names = self.files.names(os.path.join(self.path, "versions"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict | None:
        """What a version names; None if it can't be read."""
        text = self.files.read(os.path.join(self.path, "versions", f"{version}.json"))
        try:
            found = json.loads(text or "")
            whole = all(self.files.size(os.path.join(self.path, t, s["folder"])) == s["length"] for t in found["tables"] for s in found["tables"][t])
            whole = whole and (found["model"] is None or self.files.exists(os.path.join(self.path, "models", found["model"])))
        except (ValueError, KeyError, TypeError, AttributeError):
            return None
        old = found["tables"].get("postings") and found.get("form") != FORM
        return found if whole and not old else None

    def version(self) -> int:
        """The last version that can be read; 0 before the first commit or after ``drop``."""
        return next((v for v in reversed(self._numbers()) if self._manifest(v) is not None), 0)

    def broken(self) -> list[int]:
        """Versions after the last good one, which are passed over."""
        good = self.version()
        return [v for v in self._numbers() if v > good]

    def segments(self, table: str, version: int | None = None) -> list[dict]:
        """folder, seq, bytes, rows and marks of a table's segments, the oldest first."""
        v = self.version() if version is None else version
        return (self._manifest(v) or {}).get("tables", {}).get(table, []) if v else []

    def batch(self, stream: str) -> int:
        """The last batch of a stream that went into the collection; -1 if there is none."""
        v = self.version()
        return (self._manifest(v) or {}).get("batches", {}).get(stream, -1) if v else -1

    def model(self, version: int | None = None) -> dict | None:
        """What the codes of a version were made with."""
        v = self.version() if version is None else version
        name = (self._manifest(v) or {}).get("model") if v else None
        return json.loads(self.files.read(os.path.join(self.path, "models", name))) if name else None

    # ---- reading

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a version; an empty one with its schema if there is none."""
        return self._live(table, self.segments(table, version))

    def _live(self, table: str, segments: list[dict]) -> DataFrame:
        """The rows that no later segment marks."""
        schema, key = TABLES[table], KEYS[table]
        rows = [s for s in segments if s["rows"]]
        if not rows:
            return self.spark.createDataFrame([], schema)
        newest = max((s["seq"] for s in segments if s["marks"]), default=-1)
        scan = lambda s: self.spark.read.schema(schema).parquet(os.path.join(self.path, table, s["folder"], "rows"))
        out = [scan(s) for s in rows if s["seq"] >= newest]
        older = [scan(s).withColumn("_seq", F.lit(s["seq"])) for s in rows if s["seq"] < newest]
        if older:
            marks = self._marks(table, segments)
            marks = F.broadcast(marks) if sum(s["marks"] for s in segments) <= MARKS else marks
            both = _union(older)
            out.append(both.join(marks, (both[key] == marks["_key"]) & (both["_seq"] < marks["_at"]), "left_anti").drop("_seq"))
        return _union(out)

    def _marks(self, table: str, segments: list[dict]) -> DataFrame:
        """(_key, _at): the last segment that marks each file."""
        schema = T.StructType().add("_key", T.StringType()).add("_at", T.LongType())
        paths = [os.path.join(self.path, table, s["folder"], "marks") for s in segments if s["marks"]]
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found.groupBy("_key").agg(F.max("_at").alias("_at"))

    # ---- writing

    def _write(self, table: str, attempt: str, seq: int, rows: DataFrame | None, marks: DataFrame | None, dealt: bool = False) -> dict | None:
        """A segment of these rows and marks; None if there are none. Rows that are ``dealt`` keep their tasks and order."""
        folder, made = os.path.join(self.path, table, attempt), {"folder": attempt, "seq": seq, "rows": 0, "marks": 0, "bytes": 0}
        if rows is not None:
            order = ORDER[table]
            cast = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]])
            cast = cast if dealt else cast.hint("rebalance", order[0]).sortWithinPartitions(*order)
            cast.write.options(**PACKED).parquet(os.path.join(folder, "rows"))
            made["rows"] = self.spark.read.schema(TABLES[table]).parquet(os.path.join(folder, "rows")).count()
            made["bytes"] = self.files.size(os.path.join(folder, "rows"))
        if marks is not None:
            marks.hint("rebalance").write.parquet(os.path.join(folder, "marks"))
            made["marks"] = self.spark.read.schema(marks.schema).parquet(os.path.join(folder, "marks")).count()
        if not made["rows"] and not made["marks"]:
            self.files.delete(folder)
            return None
        return made | {"length": self.files.size(folder)}

    def _together(self, jobs: dict[str, Callable[[], dict | None]]) -> dict[str, dict | None]:
        """What the jobs give, run side by side: small tables leave most cores free."""
        if len(jobs) < 2:
            return {k: job() for k, job in jobs.items()}
        with ThreadPoolExecutor(len(jobs)) as pool:
            running = {k: pool.submit(inheritable_thread_target(self.spark)(job)) for k, job in jobs.items()}
        return {k: r.result() for k, r in running.items()}

    def _segments(self, attempt: str, tables: dict[str, tuple[int, Rows, DataFrame | None]], dealt: tuple[str, ...]) -> dict[str, dict | None]:
        """The segments of (seq, rows, marks) of each table; nothing is left of them if one fails."""
        try:
            written = {}
            if "points" in tables and any(callable(rows) for _, rows, _ in tables.values()):
                seq, rows, marks = tables["points"]
                written["points"] = made = self._write("points", attempt, seq, rows, marks, "points" in dealt)
                points = self._live("points", [made | {"marks": 0}] if made else [])
                tables = {t: (s, r(points) if callable(r) else r, m) for t, (s, r, m) in tables.items() if t != "points"}
            return written | self._together({t: partial(self._write, t, attempt, s, r, m, t in dealt) for t, (s, r, m) in tables.items()})
        except BaseException:
            for table in TABLES:
                self.files.delete(os.path.join(self.path, table, attempt))
            raise

    def _publish(self, base: int, attempt: str, tables: dict[str, list[dict]], model: str | None, batch: tuple[str, int] | None = None) -> int:
        batches = (self._manifest(base) or {}).get("batches", {}) | (dict([batch]) if batch else {})
        new = max(self._numbers(), default=0) + 1 if self.version() == base else base + 1
        manifest = {"attempt": attempt, "at": time.time(), "tables": tables, "model": model, "batches": batches, "form": FORM}
        if self.version() != base or not self.files.create(os.path.join(self.path, "versions", f"{new}.json"), json.dumps(manifest)):
            raise ConcurrentWrite(f"{self.name} is at version {self.version()}, not {base}")
        return new

    def _begin(self, base: int) -> tuple[str, dict]:
        if (now := self.version()) != base:
            raise ConcurrentWrite(f"{self.name} is at version {now}, not {base}")
        old = self._manifest(base) if base else None
        return self._attempt(base), old or {"tables": {t: [] for t in TABLES}, "model": None}

    def _attempt(self, base: int) -> str:
        return f"v={base + 1}-{int(time.time())}-{uuid.uuid4().hex[:12]}"

    def _save_model(self, model: dict | None) -> str | None:
        if model is None:
            return None
        name = f"{int(time.time())}-{uuid.uuid4().hex[:12]}.json"
        self.files.replace(os.path.join(self.path, "models", name), json.dumps(model))
        return name

    def _finish(self, base: int, attempt: str, tables: dict, model: str | None, written: list[str], batch: tuple[str, int] | None) -> int:
        try:
            return self._publish(base, attempt, tables, model, batch)
        except BaseException:
            for table in written:
                self.files.delete(os.path.join(self.path, table, attempt))
            raise

    def commit(self, base: int, model: dict | None = None, batch: tuple[str, int] | None = None, dealt: tuple[str, ...] = (), **tables: Rows) -> int:
        """A new version after ``base``, with these tables whole; the others stay as they are, but for codes,
        which belong to the points and ``model``. ``batch`` is the stream and batch that it is made for. Tables that are named in
        ``dealt`` have tasks of a fit size and rows in order, and are written by these."""
        attempt, old = self._begin(base)
        named = {t: old["tables"].get(t, []) for t in TABLES}
        kept = old["model"]
        if "points" in tables or "codes" in tables:
            named["codes"], kept = [], self._save_model(model)
        seq = {t: 1 + max((s["seq"] for s in named[t]), default=0) for t in tables}
        for table, made in self._segments(attempt, {t: (seq[t], df, None) for t, df in tables.items()}, dealt).items():
            named[table] = [made] if made else []
        return self._finish(base, attempt, named, kept, list(tables), batch)

    def change(self, base: int, batch: tuple[str, int] | None = None, dealt: tuple[str, ...] = (), **changes: tuple[DataFrame, Rows]) -> int:
        """A new version after ``base``, in which the rows of some files are others.

        For each table: (keys, rows), where ``keys`` has the paths whose rows go, and ``rows``
        are the new ones. Nothing else is read or written. ``dealt`` is as in ``commit``.
        """
        attempt, old = self._begin(base)
        named = {t: list(old["tables"].get(t, [])) for t in TABLES}
        jobs = {}
        for table, (keys, rows) in changes.items():
            seq = 1 + max((s["seq"] for s in named[table]), default=0)
            marks = keys.select(F.col(keys.columns[0]).cast("string").alias("_key")).distinct().withColumn("_at", F.lit(seq).cast("long")) if named[table] else None
            jobs[table] = (seq, rows, marks)
        for table, made in self._segments(attempt, jobs, dealt).items():
            named[table] += [made] if made else []
        return self._finish(base, attempt, named, old["model"], list(changes), batch)

    def compact(self, whole: bool = False) -> int:
        """Merge what is due, or with ``whole`` all segments of each table; how many were merged."""
        merged = 0
        for table in TABLES:
            segments = self.segments(table)
            start = 0 if whole and len(segments) > 1 else due(segments, self.fan)
            if start is None:
                continue
            run = segments[start:]
            attempt = self._attempt(self.version())
            marks = self._marks(table, run) if start and any(s["marks"] for s in run) else None
            made = self._write(table, attempt, run[-1]["seq"], self._live(table, run), marks)
            if self._swap(table, run, made):
                merged += len(run)
            elif made:
                self.files.delete(os.path.join(self.path, table, attempt))
        return merged

    def _swap(self, table: str, run: list[dict], made: dict | None, times: int = 5) -> bool:
        """A version with ``made`` in the place of ``run``, on top of whatever was committed meanwhile."""
        for _ in range(times):
            base = self.version()
            now = self._manifest(base)
            segments = now["tables"].get(table, []) if now else []
            at = next((k for k in range(len(segments)) if segments[k : k + len(run)] == run), None)
            if at is None:
                return False
            tables = now["tables"] | {table: segments[:at] + ([made] if made else []) + segments[at + len(run) :]}
            try:
                self._publish(base, now["attempt"], tables, now["model"])
                return True
            except ConcurrentWrite:
                continue
        return False

    def vacuum(self, keep: int = 2, seconds: float = 0.0) -> None:
        """Remove all but the last ``keep`` good versions and those of the last ``seconds``, and what failed writes
        left before that."""
        good, since = {v: m for v in self._numbers() if (m := self._manifest(v)) is not None}, time.time() - seconds
        kept = {v: m for v, m in good.items() if v in sorted(good)[-keep:] or (seconds and m["at"] > since)}
        named = {(t, s["folder"]) for m in kept.values() for t, of in m["tables"].items() for s in of}
        known = {(t, s["folder"]) for m in good.values() for t, of in m["tables"].items() for s in of}
        for v in self._numbers():
            if v not in kept:
                self.files.delete(os.path.join(self.path, "versions", f"{v}.json"))
        for table in TABLES:
            for attempt in self.files.names(os.path.join(self.path, table)):
                young = seconds and int(attempt.split("-")[1]) > since
                if (table, attempt) not in named and ((table, attempt) in known or not young):
                    self.files.delete(os.path.join(self.path, table, attempt))
        models = {m["model"] for m in kept.values()}
        for name in self.files.names(os.path.join(self.path, "models")):
            if name not in models and not (seconds and name.split("-")[0].isdigit() and int(name.split("-")[0]) > since):
                self.files.delete(os.path.join(self.path, "models", name))

    def create(self) -> int:
        """An empty first version; nothing if there is one."""
        return self.version() or self.commit(0)

    def drop(self) -> None:
        """Remove the collection; nothing if it is absent."""
        self.files.delete(os.path.join(self.path, "versions"))
        self.files.delete(self.path)

    def scroll(self, source_file: str, limit: int = 100) -> DataFrame:
        """A file's points in order; the equality is pushed to the scan."""
        return self.read("points").filter(F.col("source_file") == source_file).orderBy("chunk_index").limit(limit)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't there."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def replace(old: DataFrame, changed: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """All rows of the ``changed`` keys out, ``new`` in; a key may end with no row."""
    return delete(old, changed, key).unionByName(new)
