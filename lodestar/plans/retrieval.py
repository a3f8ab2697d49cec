"""Hybrid retrieval of a batch of queries, as one lazy plan.

Dense and sparse top-n, fusion by reciprocal rank, rerank, projection. Ranks
are row numbers partitioned by query, with the limit on the bare rank, so that
each task prunes its share before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import sparse
from lodestar.functions.batches import ranges
from lodestar.functions.text import WORD_TOKEN, tokens
from lodestar.storage import materialise

#: Bytes of the queries that are sent to the tasks at once.
BROADCAST_BYTES = 8 << 20
#: Points and queries of one matrix product.
TILE = 2048, 1024
#: Queries that are sent to the tasks at once by their terms, scores of one tile of points, and terms of points, or pairs
#: of these and the queries that hold them, that a task works on at once.
QUERIES, SCORES, ENTRIES = 10_000, 1 << 20, 1 << 19
RRF_K = 2.0


def ranked(scored: DataFrame, n: int, score: str = "score", by: str = "query_id", tie: str = "id", name: str = "rank") -> DataFrame:
    """The ``n`` best rows of each query with their rank from 1; ties by id."""
    if n <= 0:
        raise ValueError("the number of results must be positive")
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unit_rows(ids: pa.Array, dense: pa.Array, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors, in double precision, of the rows that are vectors of ``dim``
    finite numbers and not zero."""
    whole = pc.equal(pc.list_value_length(dense), dim).fill_null(False)
    ids, dense = ids.filter(whole), dense.filter(whole)
    rows = dense.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    length = np.sqrt((rows * rows).sum(1))
    fine = np.isfinite(length) & (length > 0)
    return ids.filter(pa.array(fine)), rows[fine] / length[fine, None]


def _cut(q: np.ndarray, score: np.ndarray, ids: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``n`` best of each query by score, then id."""
    order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -score, q))
    order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < n]
    return q[order], score[order], ids.take(pa.array(order))


class best_points:  # noqa: N801
    """Keeps the ``n`` best points of each query, fed batch by batch; memory is that of the
    queries, their results and one tile of scores."""

    def __init__(self, keys: pa.Array, queries: np.ndarray, n: int, digits: int | None):
        self.keys, self.queries, self.n, self.digits = keys, queries, n, digits
        self.pool = None
        self.least = np.full(len(queries), -np.inf)

    def add(self, ids: pa.Array, dense: pa.Array) -> None:
        n = self.n
        ids, points = unit_rows(ids, dense, self.queries.shape[1])
        for a in range(0, len(points) if len(self.queries) else 0, TILE[0]):
            found = []
            for b in range(0, len(self.queries), TILE[1]):
                score = points[a : a + TILE[0]] @ self.queries[b : b + TILE[1]].T
                score = np.round(score, self.digits) if self.digits is not None else score
                bar = self.least[b : b + TILE[1]]
                if len(score) > n:
                    bar = np.maximum(bar, np.partition(score, len(score) - n, axis=0)[len(score) - n])
                at, q = np.nonzero(score >= bar)
                found.append((at + a, q + b, score[at, q]))
            at, q, score = (np.concatenate(c) for c in zip(*found, strict=True))
            mine = ids.take(pa.array(at))
            pool = self.pool
            self.pool = pool = _cut(q, score, mine, n) if pool is None else _cut(np.concatenate([pool[0], q]), np.concatenate([pool[1], score]), pa.concat_arrays([pool[2], mine]), n)
            full = np.flatnonzero(np.bincount(pool[0], minlength=len(self.queries)) == n)
            self.least[full] = pool[1][np.searchsorted(pool[0], full, side="right") - 1]

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.pool is not None:
            q, score, ids = self.pool
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(q)), ids, pa.array(score)], ["query_id", "id", "score"])


def _best_of(held, n: int, digits: int | None):
    """``held`` is a broadcast (query ids, unit vectors)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = best_points(*held.value, n, digits)
        for batch in batches:
            kept.add(*batch.columns)
        yield from kept.result()

    return best


def dense_topk(points: DataFrame, queries: DataFrame, n: int, digits: int | None = 6, bytes_per_row: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) by exact cosine.

    ``points(id, dense)``, ``queries(query_id, dense)``. Every query meets every point,
    which is the exact search's nature (``operators.cells`` has an approximate one). Queries
    are sent as matrices of at most BROADCAST_BYTES, by their number and measured
    length (or ``bytes_per_row``). Each block is one scan of the points, in which a task
    takes matrix products and keeps the ``n`` best before the shuffle. With several
    blocks, the result of each is written before the next is fetched, so neither
    the driver nor a task holds two. Vectors that are null, zero, not finite or of another
    length than the longest query have no score.
    """
    if n <= 0:
        raise ValueError("the number of results must be positive")
    spark = points.sparkSession
    asked = queries.select("query_id", "dense").filter("size(dense) > 0")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("dense")).alias("dim")).first()
    blocks = max(1, -(-size["n"] * (bytes_per_row or 8 * (size["dim"] or 0)) // BROADCAST_BYTES))
    scan = points.select("id", "dense").filter("dense IS NOT NULL")
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", scan.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    parts = []
    for k in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        rows = block.toArrow().combine_chunks()
        if not len(rows):
            continue
        held = spark.sparkContext.broadcast(unit_rows(rows["query_id"].chunk(0), rows["dense"].chunk(0), size["dim"]))
        part = ranked(scan.mapInArrow(_best_of(held, n, digits), schema), n)
        if blocks > 1:
            part = materialise(part, "dense")
            held.destroy()
        parts.append(part)
    return _union(parts) if parts else spark.createDataFrame([], schema.add("rank", T.IntegerType()))


class _Asked:
    """The terms of a block of queries: which queries hold each."""

    def __init__(self, keys: pa.Array, terms: pa.Array):
        self.keys = keys
        words = terms.flatten()
        query = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())
        self.terms = pc.unique(words)
        of = pc.index_in(words, value_set=self.terms).to_numpy()
        order = np.argsort(of, kind="stable")
        self.query = query[order]
        self.first = np.searchsorted(of[order], np.arange(len(self.terms) + 1))


class best_sums:  # noqa: N801
    """Keeps the ``n`` best points of each query, fed batch by batch. Beside the batch, memory is that of the queries,
    their results, one tile of scores and ENTRIES terms or pairs of a point's term and a query, or those of one point:
    common terms, that many queries hold, make tiles of fewer points."""

    def __init__(self, asked: _Asked, n: int, digits: int | None):
        self.asked, self.n, self.digits = asked, n, digits
        self.pool = None
        self.least = np.full(len(asked.keys), -np.inf)

    def add(self, ids: pa.Array, listed: pa.Array) -> None:
        for a, b in ranges(pc.list_value_length(listed).fill_null(0).to_numpy(), ENTRIES, len(listed)):
            self._slice(ids[a:b], listed[a:b])

    def _slice(self, ids: pa.Array, listed: pa.Array) -> None:
        asked = self.asked
        entries = listed.flatten()
        doc = np.repeat(np.arange(len(ids)), pc.list_value_length(listed).fill_null(0).to_numpy())
        term = pc.index_in(entries.field("term"), value_set=asked.terms)
        some = np.flatnonzero(pc.is_valid(term).to_numpy(zero_copy_only=False))
        doc, weight = doc[some], entries.field("weight").to_numpy()[some]
        term = term.take(pa.array(some)).to_numpy()
        many = asked.first[term + 1] - asked.first[term]
        load = np.bincount(doc, many, len(ids)).astype(np.int64)
        for a, b in ranges(load, ENTRIES, max(1, SCORES // len(asked.keys))):
            x, y = np.searchsorted(doc, [a, b])
            if x < y:
                self._tile(ids[a:b], doc[x:y] - a, term[x:y], weight[x:y], many[x:y])

    def _tile(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, many: np.ndarray) -> None:
        asked, n, q_count = self.asked, self.n, len(self.asked.keys)
        pairs = int(many.sum())
        cell = asked.query[np.repeat(asked.first[term] - np.cumsum(many) + many, many) + np.arange(pairs)] + np.repeat(doc * q_count, many)
        score = np.bincount(cell, np.repeat(weight, many), minlength=len(ids) * q_count)
        met = np.zeros(len(score), dtype=bool)
        met[cell] = True
        score = np.where(met, np.round(score, self.digits) if self.digits is not None else score, -np.inf).reshape(len(ids), q_count)
        bar = self.least
        if len(score) > n:
            bar = np.maximum(bar, np.partition(score, len(score) - n, axis=0)[len(score) - n])
        at, q = np.nonzero((score >= bar) & (score > -np.inf))
        if not len(at):
            return
        found, pool = (q, score[at, q], ids.take(pa.array(at))), self.pool
        self.pool = pool = _cut(*found, n) if pool is None else _cut(np.concatenate([pool[0], found[0]]), np.concatenate([pool[1], found[1]]), pa.concat_arrays([pool[2], found[2]]), n)
        full = np.flatnonzero(np.bincount(pool[0], minlength=q_count) == n)
        self.least[full] = pool[1][np.searchsorted(pool[0], full, side="right") - 1]

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.pool is not None:
            q, score, ids = self.pool
            yield pa.RecordBatch.from_arrays([self.asked.keys.take(pa.array(q)), ids, pa.array(score)], ["query_id", "id", "score"])


def _best_sums(held, n: int, digits: int | None):
    """``held`` is a broadcast _Asked."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = best_sums(held.value, n, digits)
        for batch in batches:
            kept.add(*batch.columns)
        yield from kept.result()

    return best


def sparse_topk(postings: DataFrame, queries: DataFrame, n: int, digits: int | None = 6, pattern: str = WORD_TOKEN, stop_words: tuple[str, ...] = (), few_terms: int = 0) -> DataFrame:
    """(query_id, id, score, rank) by the sum of the weights of the query's distinct terms.

    ``postings(term, id, weight)`` or ``sparse.vectors``; ``queries(query_id, text)``. Points
    that share no term are absent. Postings are limited to the queries' terms by a join and
    gathered by point; vectors hold that already. A task then sums a tile of points against
    a block of queries at once and keeps the ``n`` best, so no row is made for a
    term that a point and a query share, however common it is. Queries are sent in blocks
    of QUERIES, and of BROADCAST_BYTES of their terms; with several, each one's result is written before the next is fetched. Queries
    with up to ``few_terms`` terms in all have these pushed to the scan, which prunes postings
    that are sorted by term, and takes all others out of vectors before these leave the JVM.
    """
    if n <= 0:
        raise ValueError("the number of results must be positive")
    spark = postings.sparkSession
    words = queries.select("query_id", F.array_distinct(sparse.without(tokens(F.col("text"), pattern), stop_words)).alias("terms")).filter("size(terms) > 0")
    n_queries, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("terms", "  "))), F.lit(0))).first()
    blocks = max(1, -(-n_queries // QUERIES), -(-size // BROADCAST_BYTES))
    schema = T.StructType([T.StructField("query_id", words.schema["query_id"].dataType), T.StructField("id", postings.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    parts = []
    for k in range(blocks):
        rows = (words if blocks == 1 else words.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).toArrow().combine_chunks()
        if not len(rows):
            continue
        asked = _Asked(rows["query_id"].chunk(0), rows["terms"].chunk(0))
        vectors = postings
        if "terms" not in postings.columns:
            terms = spark.createDataFrame([(t,) for t in asked.terms.to_pylist()], "term string")
            mine = postings.filter(F.col("term").isin(asked.terms.to_pylist())) if len(asked.terms) <= few_terms else postings.join(F.broadcast(terms), "term")
            vectors = mine.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
        elif len(asked.terms) <= few_terms:
            wanted = asked.terms.to_pylist()
            vectors = postings.select("id", F.filter("terms", lambda t: t["term"].isin(wanted)).alias("terms")).filter("size(terms) > 0")
        held = spark.sparkContext.broadcast(asked)
        part = ranked(vectors.select("id", "terms").mapInArrow(_best_sums(held, n, digits), schema), n)
        if blocks > 1:
            part = materialise(part, "sparse")
            held.destroy()
        parts.append(part)
    return _union(parts) if parts else spark.createDataFrame([], schema.add("rank", T.IntegerType()))


def rrf(dense: DataFrame, sparse_: DataFrame, n: int, k: float = RRF_K, digits: int | None = 9, weights: tuple[float, float] | None = None) -> DataFrame:
    """(query_id, id, score, rank): sums of 1 / (k + rank), ranks from 0.

    A union and one aggregation rather than a full outer join. ``weights`` scales
    the two lists; by default they count alike.
    """
    wd, ws = weights or (1.0, 1.0)
    parts = [d.select("query_id", "id", (F.lit(w) / (F.lit(k) + F.col("rank") - 1)).alias("part")) for d, w in ((dense, wd), (sparse_, ws))]
    total = F.sum("part")
    fused = parts[0].unionByName(parts[1]).groupBy("query_id", "id").agg((F.round(total, digits) if digits is not None else total).alias("score"))
    return ranked(fused, n)


def overlap(query: Column, passage: Column, pattern: str = WORD_TOKEN) -> Column:
    """Stand-in for a cross-encoder: share of the query's distinct terms in the passage."""
    terms = F.array_distinct(tokens(query, pattern))
    return F.size(F.array_intersect(terms, tokens(passage, pattern))).cast("double") / F.nullif(F.size(terms), F.lit(0))


def rerank(fused: DataFrame, points: DataFrame, queries: DataFrame, top_k: int, pattern: str = WORD_TOKEN, digits: int = 6, scorer=overlap, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``top_k`` of each query by ``scorer(query, passage)``; ties keep the fused order.

    Texts are joined to the few candidates here and nowhere before. Columns of the
    points that are named in ``keep`` stay.
    """
    texts = points.select("id", F.col("text").alias("_passage"), *keep)
    asked = queries.select("query_id", F.col("text").alias("_query"))
    scored = fused.join(texts, "id").join(asked, "query_id").withColumn("rerank_score", F.round(F.coalesce(scorer(F.col("_query"), F.col("_passage"), pattern), F.lit(0.0)), digits))
    return ranked(scored.withColumnRenamed("rank", "fused_rank"), top_k, "rerank_score", tie="fused_rank").drop("_passage", "_query")


def search(points: DataFrame, postings: DataFrame, queries: DataFrame, top_k: int = 5, rerank_candidates: int = 50, pattern: str = WORD_TOKEN, k: float = RRF_K, fusion: str = "rrf", w_dense: float = 0.7, w_sparse: float = 0.3, scorer=overlap, stop_words: tuple[str, ...] = (), index=None, probes: int = 16, vectors: DataFrame | None = None, few_terms: int = 0) -> DataFrame:
    """Hybrid search: (query_id, rank, text, source_file, chunk_index, total_chunks, score, rerank_score).

    ``score`` is the fused score while the order is the rerank's, so it need not
    fall down the list. The same candidate number bounds both prefetches and the
    fusion. Weights only count with ``fusion="weighted"``, an extension. With an ``index``
    (``operators.cells``) the dense leg searches the ``probes`` nearest cells of each query.
    Where vectors are a table of their own, ``vectors`` (id, dense) saves joining them to texts.
    """
    for w in (w_dense, w_sparse):
        if not 0 <= w <= 1:
            raise ValueError("weights lie between 0 and 1")
    if top_k <= 0 or rerank_candidates <= 0:
        raise ValueError("top_k and rerank_candidates must be positive")
    dense = dense_topk(points if vectors is None else vectors, queries, rerank_candidates) if index is None else index.search(queries, rerank_candidates, probes)
    by_term = sparse_topk(postings, queries, rerank_candidates, pattern=pattern, stop_words=stop_words, few_terms=few_terms)
    fused = rrf(dense, by_term, rerank_candidates, k, weights=(w_dense, w_sparse) if fusion == "weighted" else None)
    best = rerank(fused, points, queries, top_k, pattern, scorer=scorer, keep=("text", "source_file", "chunk_index", "total_chunks"))
    return best.select("query_id", "rank", "text", "source_file", "chunk_index", "total_chunks", "score", "rerank_score")
