"""A block-max inverted index of sparse vectors.

Points come to a task in their order and are inverted in shards of about POSTINGS postings, by their length: a term's postings in
a shard, by point, are cut into blocks of BLOCK, each of which knows its largest weight. Building needs no
shuffle, and a shard fits into a worker. A shard's first row, without a term, has the ids of its points.

A search reads the blocks of the queries' terms and deals them out by shard. About one of SAMPLE shards is
searched first; the ``n``-th best score there is one that a point of the others must reach. In a shard, a query's terms are
added up from those with the shortest lists for their largest weights on. As soon as the terms that are left can't lift a
point to that score (or to the ``n`` best of the shards that the task had before), no further points are taken in: the rest of the
lists, the longest ones, is looked up for the points that can still get there, in those blocks only that hold one, and a
point is let go when its block's largest weight is too small for it. The result is the exact one.

Defined cases: points without terms are never found; queries without terms, or with unknown ones, find
nothing; a term counts once in a query; equal scores, at the digits asked for, go to the smaller id; repeated ids
are points of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import sparse
from lodestar.functions.text import WORD_TOKEN, tokens
from lodestar.plans.retrieval import BROADCAST_BYTES, _cut, _union, ranked
from lodestar.storage import materialise

POSTINGS, BLOCK, SAMPLE = 1 << 20, 16, 16


def _schema(id_type: T.DataType) -> T.StructType:
    return (
        T.StructType().add("shard", T.LongType()).add("term", T.StringType()).add("block", T.IntegerType()).add("top", T.DoubleType())
        .add("points", T.ArrayType(T.IntegerType())).add("weights", T.ArrayType(T.DoubleType())).add("ids", T.ArrayType(id_type))
    )


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)


def _inverted(shard: int, ids: pa.Array, listed: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its ids, then its blocks by term."""
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    # points of a like length have like weights, so that blocks' largest weights tell more
    order = pa.array(np.argsort(pc.list_value_length(listed).fill_null(0).to_numpy(), kind="stable"))
    ids, listed = ids.take(order), listed.take(order)
    count = pc.list_value_length(listed).fill_null(0).to_numpy()
    entries = listed.flatten()
    words = entries.field("term").dictionary_encode()
    number = pc.rank(words.dictionary, tiebreaker="dense").to_numpy()[words.indices.to_numpy()].astype(np.int64) - 1
    order = np.lexsort((np.repeat(np.arange(len(ids)), count), number))
    number, point, weight = number[order], np.repeat(np.arange(len(ids)), count)[order], entries.field("weight").to_numpy()[order]
    first = _starts(number)
    size = np.diff(np.append(first, len(number)))
    block = (np.arange(len(number)) - np.repeat(first, size)) // BLOCK
    cut = _starts(number * (1 << 32) + block)
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([0.0]), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.float64())), lists([0, len(ids)], ids)], names)
    if not len(cut):
        return
    by_rank = words.dictionary.take(pc.sort_indices(words.dictionary))
    offsets = np.append(cut, len(number))
    whole = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cut), shard)), by_rank.take(pa.array(number[cut])), pa.array(block[cut].astype(np.int32)), pa.array(np.maximum.reduceat(weight, cut)),
         lists(offsets, pa.array(point.astype(np.int32))), lists(offsets, pa.array(weight)), pa.nulls(len(cut), pa.list_(ids.type))], names)
    for a in range(0, len(cut), 20_000):
        yield whole.slice(a, 20_000)


def build(vectors: DataFrame, key: str = "id") -> DataFrame:
    """The blocks of ``sparse.vectors``(key, terms), to be written as a table."""
    schema = _schema(vectors.schema[key].dataType)

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for a in range(0, len(batch), 1000):
                held.append(batch.slice(a, 1000))
                size += len(held[-1].column(1).flatten())
                if size >= POSTINGS:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    yield from _inverted(shard, rows.column(0).chunk(0), rows.column(1).chunk(0), schema.names)
                    shard, held, size = shard + 1, [], 0
        if size:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from _inverted(shard, rows.column(0).chunk(0), rows.column(1).chunk(0), schema.names)

    return vectors.select(key, "terms").mapInArrow(inverted, schema)


class _Shard:
    """The lists of a shard: for each term its blocks, and for each block its postings."""

    def __init__(self, rows: pa.Table):
        has = pc.is_valid(rows["term"])
        self.ids = rows.filter(pc.invert(has))["ids"].combine_chunks().flatten()
        rows = rows.filter(has).combine_chunks()
        if not len(rows):
            self.of = {}
            return
        words = rows["term"].chunk(0).dictionary_encode()
        at = words.indices.to_numpy()
        cut = np.append(_starts(at), len(at))
        self.of = dict(zip(words.dictionary.take(pa.array(at[cut[:-1]])).to_pylist(), zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True), strict=True))
        points = rows["points"].chunk(0)
        self.point, self.weight = points.flatten().to_numpy().astype(np.int64), rows["weights"].chunk(0).flatten().to_numpy()
        self.begin = np.append(0, np.cumsum(pc.list_value_length(points).to_numpy()))
        self.top = rows["top"].chunk(0).to_numpy()
        self.last = self.point[self.begin[1:] - 1]
        self.first = self.point[self.begin[:-1]]

    def search(self, terms: list[str], n: int, least: float, slack: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(points, scores) that hold the ``n`` best of at least ``least``, the postings that were looked at, and those there are."""
        lists = [(int(self.begin[e] - self.begin[a]), a, e, float(self.top[a:e].max())) for a, e in (self.of[t] for t in terms if t in self.of)]
        lists.sort(key=lambda x: (x[0] / x[3] if x[3] > 0 else np.inf, x[1]))
        total = sum(x[0] for x in lists)
        rest = np.append(np.cumsum([x[3] for x in lists][::-1])[::-1], 0.0)
        score = np.zeros(len(self.ids))
        seen, k = 0, 0
        for k, (size, a, e, _) in enumerate(lists):
            if rest[k] < least - slack:
                break
            x, y = self.begin[a], self.begin[e]
            score[self.point[x:y]] += self.weight[x:y]
            seen += size
            if len(score) > n and k + 1 < len(lists):
                least = max(least, float(np.partition(score, len(score) - n)[len(score) - n]))
        else:
            k = len(lists)
        if k == 0:  # all terms together are too little
            return np.empty(0, np.int64), np.empty(0), seen, total
        open_ = np.flatnonzero((score > 0) & (score + rest[k] >= least - slack))
        got = score[open_]
        for j in range(k, len(lists)):
            _, a, e, _ = lists[j]
            block = np.minimum(a + np.searchsorted(self.last[a:e], open_), e - 1)
            inside = (self.first[block] <= open_) & (open_ <= self.last[block])
            stays = got + np.where(inside, self.top[block], 0.0) + rest[j + 1] >= least - slack
            open_, got, block, inside = open_[stays], got[stays], block[stays], inside[stays]
            need = np.unique(block[inside])
            size = self.begin[need + 1] - self.begin[need]
            seen += int(size.sum())
            pos = np.repeat(self.begin[need] - np.cumsum(size) + size, size) + np.arange(size.sum())
            if len(pos):
                here = np.minimum(np.searchsorted(self.point[pos], open_), len(pos) - 1)
                met = self.point[pos][here] == open_
                got = got + np.where(met, self.weight[pos][here], 0.0)
            if len(got) > n:
                least = max(least, float(np.partition(got, len(got) - n)[len(got) - n]))
        return open_, got, seen, total


def _best(held, n: int, digits: int | None, names: list[str], counts=None):
    """``held`` is a broadcast (query ids, lists of terms, scores to reach); ``counts``, two accumulators."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting: list[pa.Table] = []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cut = [*_starts(shard).tolist(), len(shard)]
            for a, e in zip(cut[:-1], cut[1:], strict=True):
                part = pa.Table.from_batches([batch.slice(a, e - a)])
                if waiting and waiting[0]["shard"][0].as_py() != shard[a]:
                    yield pa.concat_tables(waiting)
                    waiting = []
                waiting.append(part)
        if waiting:
            yield pa.concat_tables(waiting)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, terms, least = held.value
        least, pool = least.copy(), None
        slack = 10.0**-digits if digits is not None else 0.0
        slack += 1e-9
        for rows in shards(batches):
            shard, found = _Shard(rows), []
            for q, words in enumerate(terms):
                at, score, seen, total = shard.search(words, n, least[q], slack)
                if counts is not None:
                    counts[0].add(seen)
                    counts[1].add(total)
                found.append((np.full(len(at), q), np.round(score, digits) if digits is not None else score, at))
            q, score, at = (np.concatenate(x) for x in zip(*found, strict=True))
            mine = shard.ids.take(pa.array(at))
            pool = _cut(q, score, mine, n) if pool is None else _cut(np.concatenate([pool[0], q]), np.concatenate([pool[1], score]), pa.concat_arrays([pool[2], mine]), n)
            full = np.flatnonzero(np.bincount(pool[0], minlength=len(terms)) == n)
            least[full] = np.maximum(least[full], pool[1][np.searchsorted(pool[0], full, side="right") - 1])
        if pool is not None:
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(pool[0])), pool[2], pa.array(pool[1])], names)

    return best


def search(blocks: DataFrame, queries: DataFrame, n: int, digits: int | None = 6, pattern: str = WORD_TOKEN, stop_words: tuple[str, ...] = (), counts=None) -> DataFrame:
    """(query_id, id, score, rank) by the sum of the weights of the query's distinct terms, as ``retrieval.sparse_topk``.

    ``queries(query_id, text)`` are sent to the tasks in blocks of BROADCAST_BYTES of their terms; with several, each one's
    result is written before the next is fetched. ``blocks`` is what ``build`` gave, written as a table (shards are numbered by tasks). ``counts`` are two accumulators, of the postings that were
    looked at and of those of the queries' terms, summed over queries.
    """
    if n <= 0:
        raise ValueError("the number of results must be positive")
    spark = blocks.sparkSession
    words = queries.select("query_id", F.array_distinct(sparse.without(tokens(F.col("text"), pattern), stop_words)).alias("terms")).filter("size(terms) > 0")
    size = words.agg(F.coalesce(F.sum(F.octet_length(F.array_join("terms", "  "))), F.lit(0))).first()[0]
    parts, passes = [], max(1, -(-size // BROADCAST_BYTES))
    early = (F.pmod(F.xxhash64("shard"), F.lit(SAMPLE)) == 0) | (F.col("shard") == F.lit(blocks.filter("term IS NULL").agg(F.min("shard")).first()[0]))
    schema = T.StructType([T.StructField("query_id", words.schema["query_id"].dataType), T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    for k in range(passes):
        rows = (words if passes == 1 else words.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)).toArrow().combine_chunks()
        if not len(rows):
            continue
        keys, terms = rows["query_id"].chunk(0), rows["terms"].to_pylist()
        asked = spark.createDataFrame(pa.table([pc.unique(rows["terms"].chunk(0).flatten())], names=["_term"]))  # within the bound of the block

        def found(shards: DataFrame, least: np.ndarray, asked=asked, keys=keys, terms=terms) -> DataFrame:
            mine = shards.join(F.broadcast(asked), F.col("term") == F.col("_term"), "left").filter("_term IS NOT NULL OR term IS NULL").drop("_term")
            held = spark.sparkContext.broadcast((keys, terms, least))
            dealt = mine.repartition("shard").sortWithinPartitions("shard", "term", "block")
            return dealt.mapInArrow(_best(held, n, digits, schema.names, counts), schema)

        first = materialise(ranked(found(blocks.filter(early), np.full(len(terms), -np.inf)), n), "early", len(terms) * n)
        reached = first.filter(F.col("rank") == n).select("query_id", "score").toArrow()
        least = np.full(len(terms), -np.inf)
        least[pc.index_in(reached["query_id"], value_set=keys).to_numpy()] = reached["score"].to_numpy()
        part = ranked(first.drop("rank").unionByName(found(blocks.filter(~early), least)), n)
        if passes > 1:
            part = materialise(part, "inverted")
        parts.append(part)
    return _union(parts) if parts else spark.createDataFrame([], schema.add("rank", T.IntegerType()))
