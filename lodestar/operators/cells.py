"""An approximate index of dense vectors: cells around centres.

Centres are found by k-means on a bounded, hash-chosen sample of unit vectors; every
point goes to the cell of its nearest centre, and a cell is a folder. A search
takes the cells whose centres are nearest to each query, reads these folders only,
and scores their points exactly. With all cells probed it is the exact search.

A cell's rows come to tasks sorted, its queries first; points stream through them in
matrix products. A cell of very many points is dealt to several tasks, each with its
queries.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.plans.retrieval import best_points, ranked, unit_rows
from lodestar.sources.files import Files

#: Vectors that centres are fitted on, and points of a cell that go to one task.
SAMPLE, POINTS_IN_TASK = 20_000, 200_000
ROUNDS = 12


def fit_centres(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of the rows of ``x``, by spherical k-means from evenly chosen rows."""
    if not len(x):
        return np.empty((0, x.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        moved = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _nearest(centres: np.ndarray, k: int, name: str):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with each of the ``k`` cells nearest to it."""
        for batch in batches:
            rows = pa.table(batch.columns, names=["id", "dense"])
            at, unit = unit_rows(pa.array(np.arange(len(rows))), rows["dense"].combine_chunks(), centres.shape[1])
            if not len(at):
                continue
            score = unit @ centres.T
            order = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k] if k < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(unit), 1))
            found = rows.take(pa.array(np.repeat(at.to_numpy(), order.shape[1])))
            yield pa.RecordBatch.from_arrays([found["id"].combine_chunks(), found["dense"].combine_chunks(), pa.array(order.ravel().astype(np.int32))], [name, "dense", "cell"])

    return nearest


def _searched(n: int, digits: int | None):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, feed = None, [], None
        for batch in batches:
            where = batch.column("cell").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
            for a, e in pairwise(cuts):
                if where[a] != at:
                    if feed is not None:
                        yield from feed.result()
                    at, asked, feed = where[a], [], None
                rows = pa.Table.from_batches([batch.slice(a, e - a)])
                is_query = pc.is_valid(rows["query_id"])
                queries, points = rows.filter(is_query), rows.filter(pc.invert(is_query))
                if len(queries):
                    asked.append(queries.select(["query_id", "dense"]))
                if len(points) and asked:
                    if feed is None:
                        whole = pa.concat_tables(asked).combine_chunks()
                        dim = pc.max(pc.list_value_length(whole["dense"])).as_py()
                        feed = best_points(*unit_rows(whole["query_id"].chunk(0), whole["dense"].chunk(0), dim), n, digits)
                    feed.add(points["id"].combine_chunks(), points["dense"].combine_chunks())
        if feed is not None:
            yield from feed.result()

    return searched


class CellIndex:
    """The index of points(id, dense) below ``path``, a path of any file system of the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def build(self, points: DataFrame, cells: int = 256) -> None:
        """Fit the centres, deal all points to cells and write them; then the centres, so that
        an index that is half written isn't read."""
        scan = points.select("id", "dense").filter("size(dense) > 0")
        sample = scan.orderBy(F.xxhash64("id"), F.col("id")).limit(SAMPLE).toArrow()
        dim = pc.mode(pc.list_value_length(sample["dense"]))[0]["mode"].as_py() if len(sample) else 1
        _, unit = unit_rows(sample["id"].combine_chunks(), sample["dense"].combine_chunks(), dim) if len(sample) else (None, np.empty((0, 1)))
        centres = fit_centres(unit, cells)
        schema = T.StructType([scan.schema["id"], scan.schema["dense"], T.StructField("cell", T.IntegerType())])
        dealt = scan.mapInArrow(_nearest(centres, 1, "id"), schema) if len(centres) else scan.limit(0).withColumn("cell", F.lit(0))
        dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(os.path.join(self.path, "points"))
        self.files.replace(os.path.join(self.path, "centres.json"), json.dumps(centres.tolist()))

    def centres(self) -> np.ndarray | None:
        text = self.files.read(os.path.join(self.path, "centres.json"))
        return None if text is None else np.array(json.loads(text))

    def search(self, queries: DataFrame, n: int, probes: int, digits: int | None = 6) -> DataFrame:
        """(query_id, id, score, rank) of the best points in each query's ``probes`` nearest cells."""
        centres = self.centres()
        asked = queries.select("query_id", "dense").filter("size(dense) > 0")
        kind = {"query_id": asked.schema["query_id"].dataType, "id": T.LongType()}
        if centres is None:
            raise ValueError(f"there is no index at {self.path}")
        if len(centres):
            points = self.spark.read.parquet(os.path.join(self.path, "points"))
            kind["id"] = points.schema["id"].dataType
        out = T.StructType([T.StructField("query_id", kind["query_id"]), T.StructField("id", kind["id"]), T.StructField("score", T.DoubleType())])
        if not len(centres):
            return ranked(self.spark.createDataFrame([], out), n)
        probed = asked.mapInArrow(_nearest(centres, probes, "query_id"), T.StructType([T.StructField("query_id", kind["query_id"]), asked.schema["dense"], T.StructField("cell", T.IntegerType())]))
        cells = [r.cell for r in probed.select("cell").distinct().collect()]  # as many as there are centres, at most
        read = points.filter(F.col("cell").isin(cells))
        parts = read.groupBy("cell").agg(F.ceil(F.count("*") / POINTS_IN_TASK).cast("int").alias("parts"))
        dense = lambda c: c.cast("array<double>").alias("dense")
        mine = read.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(None).cast(kind["query_id"]).alias("query_id"), "id", dense(F.col("dense")))
        theirs = probed.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", F.lit(None).cast(kind["id"]).alias("id"), dense(F.col("dense")))
        ordered = mine.unionByName(theirs).repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("query_id").isNull())
        return ranked(ordered.mapInArrow(_searched(n, digits), out), n)
