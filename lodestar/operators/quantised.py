"""An approximate index of dense vectors that is kept with a collection's commits.

A vector goes to the cell of its nearest centre; what is left of it is cut into parts, and each part becomes
the number of its nearest entry in that part's codebook, a byte. Centres and codebooks, the model, are fitted once on a
bounded, hash-chosen sample; codes of new vectors are made with the same model, so a commit adds
its own rows to the table of codes and takes those of changed files out.

A search takes the cells whose centres are nearest to each query. The product of a query and a coded vector is that
with the centre plus one number for each part, looked up in a table of the query's products with the
codebook's entries; it takes a scan of codes only. The best ``refine`` x n candidates of each query are then scored exactly
by the vectors, which are read in the probed cells only. With all cells probed and ``refine`` large enough the result is
the exact one.

Defined cases: vectors that are null, zero, not finite or of another length than most have no code and aren't
found; a query like that finds nothing; ties go to the smaller id; an empty collection has an empty
model and finds nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.vectors import cosine
from lodestar.operators.cells import SAMPLE, fit_centres
from lodestar.plans.retrieval import _cut, _union, ranked, unit_rows
from lodestar.schemas import CODES
from lodestar.storage import materialise

#: Components of a part, entries of a codebook, and rounds of fitting.
PART, ENTRIES, ROUNDS = 4, 256, 10
#: Queries whose tables a task holds at once, candidates of a block of queries that are broadcast, and candidates for each result.
TILE, CANDIDATES, REFINE = 64, 200_000, 8


def cells_for(points: int) -> int:
    """About as many cells as there are points in one."""
    return max(1, min(4096, round(points**0.5)))


class Model:
    """Centres (cells x components) and codebooks (parts x entries x components of a part)."""

    def __init__(self, centres: np.ndarray, codebooks: np.ndarray, points: int):
        self.centres, self.codebooks, self.points = centres, codebooks, points

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def to_dict(self) -> dict:
        put = lambda x: {"shape": list(x.shape), "data": base64.b64encode(np.ascontiguousarray(x, dtype=np.float32).tobytes()).decode()}
        return {"centres": put(self.centres), "codebooks": put(self.codebooks), "points": self.points}

    @classmethod
    def from_dict(cls, found: dict) -> Model:
        get = lambda x: np.frombuffer(base64.b64decode(x["data"]), dtype=np.float32).reshape(x["shape"]).astype(np.float64)
        return cls(get(found["centres"]), get(found["codebooks"]), found["points"])

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts; the last one is filled up with zeros."""
        size = self.codebooks.shape[2]
        return np.pad(x, ((0, 0), (0, -x.shape[1] % size))).reshape(len(x), -1, size)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit vectors."""
        cell = (unit @ self.centres.T).argmax(1)
        cut = self.parts(unit - self.centres[cell])
        code = np.empty(cut.shape[:2], dtype=np.uint8)
        for j, book in enumerate(self.codebooks):
            code[:, j] = ((book * book).sum(1) - 2 * cut[:, j] @ book.T).argmin(1)
        return cell, code


def _means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Entries by k-means of the rows of ``x``, from evenly chosen distinct rows."""
    start = np.unique(x, axis=0)
    book = start[np.linspace(0, len(start) - 1, min(k, len(start))).astype(int)]
    for _ in range(rounds):
        of = ((book * book).sum(1) - 2 * x @ book.T).argmin(1)
        count = np.bincount(of, minlength=len(book))
        sums = np.column_stack([np.bincount(of, x[:, c], minlength=len(book)) for c in range(x.shape[1])])
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return np.pad(book, ((0, k - len(book)), (0, 0)), mode="edge")


def fit(points: DataFrame, cells: int | None = None) -> Model:
    """The model of points(id, dense), on at most SAMPLE of them, chosen by a hash of their ids."""
    scan = points.select("id", "dense").filter("size(dense) > 0")
    n = scan.count()
    sample = scan.orderBy(F.xxhash64("id"), F.col("id")).limit(SAMPLE).toArrow().combine_chunks()
    if not len(sample):
        return Model(np.empty((0, 1)), np.zeros((1, ENTRIES, PART)), 0)
    dim = pc.mode(pc.list_value_length(sample["dense"]))[0]["mode"].as_py()
    _, unit = unit_rows(sample["id"].chunk(0), sample["dense"].chunk(0), dim)
    model = Model(fit_centres(unit, cells or cells_for(n)).astype(np.float32).astype(np.float64), np.zeros((1, ENTRIES, PART)), n)
    if len(unit):
        left = model.parts(unit - model.centres[(unit @ model.centres.T).argmax(1)])
        model.codebooks = np.stack([_means(left[:, j], ENTRIES) for j in range(left.shape[1])]).astype(np.float32).astype(np.float64)
    return model


def encoded(points: DataFrame, model: Model) -> DataFrame:
    """The codes of points(id, source_file, dense) as a table of the store."""
    spark = points.sparkSession
    if not len(model.centres):
        return spark.createDataFrame([], CODES)
    held = spark.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table(batch.columns, names=batch.schema.names)
            at, unit = unit_rows(pa.array(np.arange(len(rows))), rows["dense"].combine_chunks(), held.value.dim)
            cell, code = held.value.encode(unit)
            kept = rows.take(at).combine_chunks()
            if len(kept):
                yield pa.RecordBatch.from_arrays([kept["id"].chunk(0), kept["source_file"].chunk(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), kept["dense"].chunk(0)], CODES.names)

    return points.select(F.col("id").cast("string").alias("id"), F.col("source_file").cast("string").alias("source_file"), F.col("dense").cast("array<float>").alias("dense")).mapInArrow(coded, CODES)


def _nearest_cells(unit: np.ndarray, model: Model, probes: int) -> np.ndarray:
    order = np.argsort(-(unit @ model.centres.T), axis=1, kind="stable")
    return order[:, :probes]


def _candidates(held, n: int):
    """``held`` is a broadcast (query ids, unit vectors, cells of each query, model)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, unit, probed, model = held.value
        cut, pool = model.parts(unit), None
        asks: dict[int, np.ndarray] = {}
        for cell in np.unique(probed).tolist():
            asks[cell] = np.flatnonzero((probed == cell).any(1))
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
            for c in np.unique(cell).tolist():
                own, at = asks.get(c, np.empty(0, np.int64)), np.flatnonzero(cell == c)
                ids = batch.column("id").take(pa.array(at))
                for a in range(0, len(own), TILE):
                    q = own[a : a + TILE]
                    table = np.einsum("qjs,jes->jqe", cut[q], model.codebooks)
                    score = np.repeat((unit[q] @ model.centres[c])[:, None], len(at), axis=1)
                    for j in range(len(table)):
                        score += table[j][:, code[at, j]]
                    bar = np.partition(score, len(at) - n, axis=1)[:, len(at) - n, None] if len(at) > n else np.full((len(q), 1), -np.inf)
                    x, y = np.nonzero(score >= bar)
                    mine = (q[x], score[x, y], ids.take(pa.array(y)))
                    pool = _cut(*mine, n) if pool is None else _cut(np.concatenate([pool[0], mine[0]]), np.concatenate([pool[1], mine[1]]), pa.concat_arrays([pool[2], mine[2]]), n)
        if pool is not None:
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(pool[0])), pool[2], pa.array(pool[1])], ["query_id", "id", "score"])

    return best


class Index:
    """A table of codes and the model that they were made with."""

    def __init__(self, codes: DataFrame, model: Model):
        self.codes, self.model = codes, model

    def search(self, queries: DataFrame, n: int, probes: int, digits: int | None = 6, refine: int = REFINE) -> DataFrame:
        """(query_id, id, score, rank) of the best points in each query's ``probes`` nearest cells."""
        spark, model = self.codes.sparkSession, self.model
        asked = queries.select("query_id", "dense").filter("size(dense) > 0")
        kind = asked.schema["query_id"].dataType
        schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
        most = n * refine
        blocks = max(1, -(-asked.count() * most // CANDIDATES))
        parts = []
        for k in range(blocks if len(model.centres) else 0):
            rows = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).toArrow().combine_chunks()
            if not len(rows):
                continue
            keys, unit = unit_rows(rows["query_id"].chunk(0), rows["dense"].chunk(0), model.dim)
            if not len(keys):
                continue
            probed = _nearest_cells(unit, model, probes)
            # as many cells as the model has, at most; rows are sorted by cell, so the scan skips row groups
            mine = self.codes.filter(F.col("cell").isin(np.unique(probed).tolist()))
            held = spark.sparkContext.broadcast((keys, unit, probed, model))
            near = materialise(ranked(mine.select("cell", "id", "code").mapInArrow(_candidates(held, most), schema), most).select("query_id", "id"), "candidates", len(keys) * most)
            vectors = spark.createDataFrame(pa.table([keys, pa.array(list(unit))], names=["query_id", "asked"]))
            met = mine.select("id", F.col("dense").cast("array<double>").alias("dense")).join(F.broadcast(near), "id").join(F.broadcast(vectors), "query_id")
            score = cosine(F.col("dense"), F.col("asked"))
            parts.append(ranked(met.select("query_id", "id", (F.round(score, digits) if digits is not None else score).alias("score")), n))
        return _union(parts) if parts else spark.createDataFrame([], schema.add("rank", T.IntegerType()))
