"""Compression of vectors to short codes: one codebook entry for each part of a vector.

Components become integers, ``floor(scale * x)``, and vectors are cut into equal parts. Each part
position has a codebook of its own, which starts as the parts of the vectors with the smallest ids. Every
round assigns all parts to their nearest entries and moves each entry to the floor of the mean
of its parts; entries without parts stay. All of it is done in integers, so the result
doesn't depend on the order of rows, the number of tasks or a lost executor.

The nearest entry is found in a vantage-point tree over the entries of the part position: a
node splits the rest at the middle of their distances to its entry, and keeps the bounds of both
halves. A search visits the nearer half first and the other one unless it must be
farther. Distances are rounded outwards (upper bounds up, lower bounds down), a half is
visited also where its bound equals the best so far, and which entry is nearer is decided by the integer squared
distances, ties by the lower index; so pruning never changes a result.

A round is one scan: each task adds its parts up, for each part position and entry one row goes to the
shuffle, and the codebooks, of a size fixed by the parameters, come back to the driver.

Defined cases: a null vector, or one that holds null or non-finite components, is left out, as is an empty one; vectors
of another length than that of the smallest kept id are left out too; ids may be null (they are
largest) or repeat (ordered by their vectors); with fewer vectors than entries, codebooks have as many entries
as there are vectors; an empty table gives an empty one. A length that can't be cut into
equal parts, or a component beyond ``LARGEST / scale``, raises ValueError. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.session import bounded, unused
from lodestar.llm.storage import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest component after scaling: squared distances of 16 components stay within a long.
LARGEST = 1 << 28
#: Entries of a node that are compared one by one.
LEAF = 2


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = points - entry
    return np.einsum("ij,ij->i", gap, gap)


class Tree:
    """Vantage-point tree over the entries (rows of integers) of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> tuple:
        if len(members) <= LEAF:
            return (members, None, None)
        # the vantage entry is the one whose distances to the others vary most
        gaps = [_squares(self.entries[members], self.entries[m]) for m in members]
        at = int(np.argmax([np.var(np.sqrt(g.astype(np.float64))) for g in gaps]))
        rest, square = np.delete(members, at), np.delete(gaps[at], at)
        order = np.argsort(square, kind="stable")
        halves = []
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            far = np.sqrt(square[half].astype(np.float64))
            halves.append((float(_down(far.min())), float(_up(far.max())), self._grow(rest[half])))
        return (members[at : at + 1], *halves)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``points``; of entries as near, the lowest."""
        entry = np.full(len(points), len(self.entries), dtype=np.int64)
        square = np.full(len(points), np.iinfo(np.int64).max)
        self._visit(self.root, points, np.arange(len(points)), entry, square)
        return entry, square

    def _visit(self, node: tuple, points: np.ndarray, who: np.ndarray, entry: np.ndarray, square: np.ndarray) -> None:
        if not len(who):
            return
        members, inner, outer = node
        for m in members.tolist():
            got = _squares(points[who], self.entries[m])
            better = (got < square[who]) | ((got == square[who]) & (m < entry[who]))
            square[who[better]], entry[who[better]] = got[better], m
        if inner is None:
            return
        far = np.sqrt(got.astype(np.float64))
        near = far <= (inner[1] + outer[0]) / 2
        for first, half in ((near, inner), (~near, outer)):
            self._visit(half[2], points, who[first], entry, square)
        for second, half in ((~near, inner), (near, outer)):
            later, least = who[second], np.maximum(_down(far[second]) - half[1], half[0] - _up(far[second]))
            open_ = _down(least) <= _up(np.sqrt(square[later].astype(np.float64)))
            self._visit(half[2], points, later[open_], entry, square)


def integers(vectors: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """Rows of ``width`` scaled integers of an array of vectors without nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    scaled = np.floor(flat * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}")
    return scaled.astype(np.int64)


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """With only the vectors whose components are all there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    v = F.col(f"`{column}`")
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine))


def _search(codebooks: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances), one column for each part position."""
    parts, _, size = codebooks.shape
    found = [Tree(codebooks[j]).nearest(points[:, j * size : (j + 1) * size]) for j in range(parts)]
    return np.column_stack([e for e, _ in found]), np.column_stack([s for _, s in found])


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as integers, by part position, entry and component; no entries if there are no vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("codes of two hexadecimal digits name 1 to 256 entries")
    bounded(vectors.sparkSession)
    rows = _usable(vectors, vector_col).select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    order = [F.col("i").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return np.empty((parts, 0, 0), dtype=np.int64)
    width = len(first[0]["v"])
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("v") == width)
    start = rows.orderBy(*order).limit(entries).select("v").toArrow()["v"].combine_chunks()
    size = width // parts
    codebooks = integers(start, width, scale).reshape(-1, parts, size).transpose(1, 0, 2).copy()
    k = codebooks.shape[1]

    for _ in range(rounds):

        def added(batches: Iterator[pa.RecordBatch], codebooks=codebooks) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(parts * k, dtype=np.int64), np.zeros((parts * k, size), dtype=np.int64)
            for batch in batches:
                points = integers(batch.column(0), width, scale)
                entry, _ = _search(codebooks, points)
                for j in range(parts):
                    own, of = points[:, j * size : (j + 1) * size], entry[:, j] + j * k
                    count += np.bincount(of, minlength=parts * k)
                    np.add.at(total, of, own)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, c]) for c in range(size))], names=["slot", "n", *(f"c{c}" for c in range(size))])

        schema = ", ".join(["slot long", "n long", *(f"c{c} long" for c in range(size))])
        sums = rows.select("v").mapInArrow(added, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", *(f"c{c}" for c in range(size)))])
        for slot, n, *total in sums.collect():  # parts * entries rows at most
            codebooks[slot // k, slot % k] = [t // n for t in total]
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: np.ndarray, vector_col: str = "embedding", scale: int = SCALE, code: str = "code", error: str = "error") -> DataFrame:
    """The usable rows of ``vectors`` with ``code``, two hexadecimal digits for each part, and ``error``,
    the squared distance to the entries; both replace columns of those names."""
    parts, k, size = codebooks.shape
    rows = _usable(vectors, vector_col).filter(F.size(F.col(f"`{vector_col}`")) == parts * size)
    if not k:
        rows = rows.limit(0)
    found = unused(rows, "found")

    @F.arrow_udf(T.StructType().add("code", T.StringType()).add("error", T.LongType()))
    def coded(batch: pa.Array) -> pa.Array:
        entry, square = _search(codebooks, integers(batch, parts * size, scale))
        text = entry.astype(np.uint8).tobytes().hex() if len(entry) else ""
        return pa.StructArray.from_arrays([pa.array([text[x : x + 2 * parts] for x in range(0, len(text), 2 * parts)], type=pa.string()), pa.array(square.sum(axis=1, dtype=np.int64))], names=["code", "error"])

    done = rows.withColumn(found, coded(F.col(f"`{vector_col}`").cast("array<double>")))
    names = [c for c in vectors.columns if c.lower() not in (code.lower(), error.lower())]
    return done.select(*[F.col(f"`{c}`") for c in names], F.col(found)["code"].alias(code), F.col(found)["error"].alias(error))


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (the sum over rows of the label, of nulls together) and codebooks_sha256."""
    vectors = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"), F.col(f"`{label_col}`").alias("label"))
    codebooks = train(vectors, "vec_id", "v")
    coded = materialise(encode(vectors, codebooks, "v").select("vec_id", "label", "code", "error"), "codes")
    # labels are few or many: sums are dealt by label after each task has added its own up, and
    # meet the rows salted by id
    salts = 64
    salted = coded.withColumn("s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    placed = salted.select("label", "s").distinct().withColumnRenamed("label", "l").join(sums, F.col("l").eqNullSafe(F.col("label"))).select("l", F.col("s").alias("z"), "label_error")
    met = salted.join(placed, F.col("label").eqNullSafe(F.col("l")) & (F.col("s") == F.col("z")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
