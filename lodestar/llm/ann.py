"""Nearest neighbours by a robust-pruned directed graph in each shard.

Vectors that are equal in every component (by 128 bits of hashes) become one node
with its smallest ids, so that a very common vector is one node of one shard. Nodes are
dealt to shards of SHARD_NODES by a hash. A shard's graph is built in batches: a greedy
beam search from the entry point proposes neighbours for each node of a batch,
robust pruning keeps a proposal unless a kept one is closer to it by the factor
ALPHA, and reverse edges are added and pruned likewise (Subramanya et al. 2019).
A query is searched in each shard by a beam search, with a wider beam where the
nodes found have fewer than ``k`` ids; the shards' best are merged.
All searches of a batch advance together, as numpy operations.

A shard's rows come to a task sorted, nodes first: it builds the graph once, and all
queries stream through it in batches. So a task holds one shard and one batch,
and neither the graph nor the queries have to fit anywhere as a whole.

Nearness is the cosine in double precision on the original vectors; ties go to
the smaller id. Vectors that are null, zero, of another length than most or
with null or non-finite components take no part. A null id takes no part.
Repeated rows (one id, one vector) are one candidate; an id with several vectors
is a candidate with each, and a query with each, of which the best is kept.
Fewer than ``k`` other rows give fewer neighbours. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.storage import materialise

#: Nodes of a shard, and queries whose searches advance together.
SHARD_NODES, QUERY_BLOCK = 8192, 1024
#: Bytes of the marks of nodes that the searches of a batch have seen.
SEEN_BYTES = 8 << 20
DEGREE, BEAM, ALPHA = 24, 48, 1.15
SEARCH_BEAM = 112


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the ``beam`` nearest that each query's search found,
    nearest first; -1 and inf where there are fewer. ``x`` and queries are unit rows;
    ``graph`` has a row of neighbours for each node, -1 where there are fewer."""
    q = len(queries)
    nodes = np.full((q, beam), -1, dtype=np.int64)
    far = np.full((q, beam), np.inf)
    done = np.zeros((q, beam), dtype=bool)
    nodes[:, 0], far[:, 0] = entry, 1 - queries @ x[entry]
    seen = np.zeros((q, len(x)), dtype=bool)
    seen[:, entry] = True
    active = np.arange(q)
    while len(active):
        open_ = ~done[active] & (nodes[active] >= 0)
        active = active[open_.any(1)]
        if not len(active):
            break
        at = (~done[active] & (nodes[active] >= 0)).argmax(1)
        done[active, at] = True
        near = graph[nodes[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        row, col = np.nonzero(fresh)
        seen[active[row], near[row, col]] = True
        d = np.full(near.shape, np.inf)
        d[row, col] = 1 - np.einsum("ij,ij->i", queries[active[row]], x[near[row, col]])
        all_d = np.concatenate([far[active], d], axis=1)
        all_n = np.concatenate([nodes[active], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        far[active], nodes[active], done[active] = (np.take_along_axis(v, best, 1) for v in (all_d, all_n, all_done))
    return nodes, far


def robust_prune(x: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, chunk: int = 256) -> np.ndarray:
    """For each point, up to ``degree`` of its proposed neighbours (-1: none), diverse ones."""
    out = np.full((len(points), degree), -1, dtype=np.int64)
    for a in range(0, len(points), chunk):
        out[a : a + chunk] = _prune(x, points[a : a + chunk], proposed[a : a + chunk], degree, alpha)
    return out


def _prune(x: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    near = x[proposed]
    ok = (proposed >= 0) & (proposed != points[:, None])
    d = np.where(ok, 2 - 2 * np.matmul(near, x[points][:, :, None])[:, :, 0], np.inf)
    order = np.lexsort((proposed, d), axis=1)
    proposed, d = np.take_along_axis(proposed, order, 1), np.take_along_axis(d, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    between = alpha**2 * (2 - 2 * np.matmul(near, near.transpose(0, 2, 1)))
    alive = np.isfinite(d)
    alive[:, 1:] &= proposed[:, 1:] != proposed[:, :-1]
    out = np.full((len(points), degree), -1, dtype=np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        first = alive.argmax(1)
        out[has, k] = proposed[rows, first][has]
        alive[has, first[has]] = False
        alive &= ~((between[rows, first] <= d) & has[:, None])
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256) -> tuple[np.ndarray, int]:
    """(graph, entry point) over unit rows, in two passes; the first prunes without slack."""
    n = len(x)
    entry = int((x @ x.mean(0)).argmax())
    random = np.random.default_rng(n)
    graph = np.full((n, degree), -1, dtype=np.int64)
    if n > 1:
        graph[:, : degree // 2] = random.integers(0, n, size=(n, degree // 2))
    graph[graph == np.arange(n)[:, None]] = -1
    for slack in (1.0, alpha):
        order = random.permutation(n)
        for a in range(0, n, batch):
            points = order[a : a + batch]
            found, _ = beam_search(x, graph, x[points], entry, beam)
            graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1), degree, slack)
            to = graph[points].ravel()
            back = np.repeat(points, degree)[to >= 0]
            to = to[to >= 0]
            s = np.argsort(to, kind="stable")
            to, back = to[s], back[s]
            targets, start, many = np.unique(to, return_index=True, return_counts=True)
            extra = np.full((len(targets), int(many.max()) if len(many) else 0), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(targets)), many), np.arange(len(to)) - np.repeat(start, many)] = back
            both = np.concatenate([graph[targets], extra], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, axis=1)  # those there are come first
            over = (both >= 0).sum(1) > degree
            graph[targets[~over]] = both[~over][:, :degree]
            graph[targets[over]] = robust_prune(x, targets[over], both[over], degree, slack)
    return graph, entry


def _valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, h1, h2) of rows that take part. Vectors keep their type, so that floats
    aren't moved as doubles; -0.0 counts as 0.0. Equal vectors have equal hashes."""
    v = F.col("v")
    kind = df.schema[vector].dataType
    plain = F.transform(F.col(vector), lambda x: (x + F.lit(0.0)).cast(kind.elementType))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), plain.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def _unit(a: np.ndarray) -> np.ndarray:
    s = a / np.abs(a).max(1, keepdims=True)
    return s / np.sqrt((s * s).sum(1, keepdims=True))


class _Shard:
    """A shard's vectors, the ids of each, and its graph."""

    def __init__(self, parts: list[pa.Table]):
        rows = pa.concat_tables(parts)
        order = np.argsort([i[0] for i in rows["ids"].to_pylist()], kind="stable")
        rows = rows.take(pa.array(order))
        self.ids = rows["ids"].to_pylist()
        self.raw = _matrix(rows["v"])
        self.x = _unit(self.raw)
        self.graph, self.entry = build(self.x)

    def nearest(self, owns: list[int], ask: np.ndarray, k: int, beam: int, block: int) -> list[tuple[int, int, float]]:
        """(query id, id, score) of the ``k`` ids with the best scores found for each query."""
        y, out = _unit(ask), []
        todo, wide, at_once = np.arange(len(y)), beam, min(block, max(16, SEEN_BYTES // len(self.x)))
        while len(todo):
            again = []
            for a in range(0, len(todo), at_once):
                part = todo[a : a + at_once]
                found, _ = beam_search(self.x, self.graph, y[part], self.entry, wide)
                for q, row in zip(part.tolist(), found, strict=True):
                    hits, own, v = row[row >= 0], owns[q], ask[q]
                    score = self.raw[hits] @ v / (np.sqrt((self.raw[hits] * self.raw[hits]).sum(1)) * np.sqrt((v * v).sum()))
                    score = np.where(np.isfinite(score), score, self.x[hits] @ y[q])
                    best: dict[int, float] = {}
                    for h, s in zip(hits.tolist(), score.tolist(), strict=True):
                        for i in self.ids[h]:
                            if i != own and s > best.get(i, -np.inf):
                                best[i] = s
                    if len(best) < k and len(hits) == wide < len(self.x):
                        again.append(q)
                        continue
                    out += [(own, i, -s) for s, i in sorted((-s, i) for i, s in best.items())[:k]]
            todo, wide = np.array(again, dtype=np.int64), min(4 * wide, len(self.x))
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _searched(k: int, beam: int, block: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes (with ids) of a shard come first; its graph is built when the first query
        comes, and the queries stream through it."""
        at, nodes, shard = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            numbers = rows["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, e in pairwise(cuts):
                if numbers[a] != at:
                    at, nodes, shard = numbers[a], [], None
                part = rows.slice(a, e - a)
                is_query = pc.is_null(part["ids"])
                if (own := part.filter(pc.invert(is_query))).num_rows:
                    nodes.append(own.select(["v", "ids"]))
                asked = part.filter(is_query)
                if asked.num_rows and nodes:
                    shard = shard or _Shard(nodes)
                    got = shard.nearest(asked["id"].to_pylist(), _matrix(asked["v"]), k, beam, block)
                    if got:
                        q, i, s = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return searched


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", shard_nodes: int = SHARD_NODES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each query, its own id excluded."""
    points = _valid(vectors, id_col, vector)
    # One node for equal vectors, with the k + 1 smallest ids: no query needs more of them.
    # Only ids and hashes are grouped; a node's vector is then fetched from the row of its smallest id.
    w = Window.partitionBy("h1", "h2").orderBy("id")
    some = points.select("id", "h1", "h2", F.size("v").alias("size")).distinct().withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
    named = materialise(some.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("size").alias("size")), "nodes")
    size = named.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    dims, n = (size["size"], size["count"]) if size else (0, 0)
    shards = max(1, -(-n // shard_nodes))
    rows = named.filter(F.col("size") == dims).select(F.col("ids")[0].alias("id"), "h1", "h2", "ids")
    fetched = points.join(rows, ["id", "h1", "h2"]).groupBy("id", "h1", "h2").agg(F.first("v").alias("v"), F.first("ids").alias("ids"))
    dealt = fetched.select(F.pmod("h1", F.lit(shards)).alias("shard"), "id", "v", "ids")
    asked = _valid(queries, id_col, vector).filter(F.size("v") == dims).select("id", "v").distinct()
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"), "id", "v", F.lit(None).cast("array<bigint>").alias("ids"))
    ordered = dealt.unionByName(sent).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("ids").isNull())
    found = ordered.mapInArrow(_searched(k, max(SEARCH_BEAM, 4 * k), query_block), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
