"""Registered queries over the standard tables, with DuckDB SQL of the same rows.

Documents stand in for files and chunks, embeddings for their vectors, benchmark
items for queries, labels for what an index knows already, events for tasks and
latency samples. Every query runs over its whole tables: a document without a vector
is searched by its text, an item without one asks by its text.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import sparse, text, vectors
from lodestar.operators import chunking, diff, inverted, markdown, quantised, stats, tasks
from lodestar.operators.catalog import Catalog
from lodestar.operators.cells import CellIndex
from lodestar.operators.embedding import HashingEmbedder
from lodestar.operators.store import ConcurrentWrite, Store, delete, replace, upsert
from lodestar.operators.sync import Settings, points_of
from lodestar.plans import retrieval
from lodestar.sources import tables
from lodestar.sources.contents import bare, with_content, write_files
from lodestar.sources.folders import list_folder
from lodestar.sources.logs import tail
from lodestar.sources.tables import spread
from lodestar.schemas import POINTS, POSTINGS
from lodestar.storage import materialise, shared_dir
from lodestar.streaming.watch import Watcher

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TOP_N, TOP_K = 50, 5
#: Tables whose rows are much work.
HEAVY = ("documents", "embeddings", "pages")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(tables.table(spark, sf_dir, name)) if name in HEAVY else tables.table(spark, sf_dir, name)


# ---- retrieval ---------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_file"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of documents; texts needn't meet them."""
    docs, vectors = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings")
    return vectors.join(docs, F.col("doc_id") == F.col("vec_id")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return items.join(vectors, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("dense"))


def _postings(points: DataFrame) -> DataFrame:
    return sparse.vectors(points, pattern=text.ORACLE_TOKEN)


_SQL_POINTS = f"""
pts AS (SELECT doc_id AS id, text, source AS source_file, embedding::DOUBLE[] AS v, regexp_extract_all(lower(text), '{text.ORACLE_TOKEN}') AS t FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
q AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS v, list_distinct(regexp_extract_all(lower(text), '{text.ORACLE_TOKEN}')) AS t FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""
_SQL_DENSE = f"""
dense AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
          FROM (SELECT q.query_id, p.id, round(list_cosine_similarity(p.v, q.v), 6) AS score FROM pts p CROSS JOIN q WHERE p.v IS NOT NULL AND q.v IS NOT NULL)) WHERE rank <= {TOP_N})"""
_SQL_WEIGHTS = """
w AS (SELECT id, term, dl, tf, tf::DOUBLE * 2.2::DOUBLE / (tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl::DOUBLE / 256.0::DOUBLE)) AS weight
      FROM (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM pts) GROUP BY ALL))"""
_SQL_SPARSE = f"""
sparse AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
           FROM (SELECT query_id, id, round(sum(weight), 6) AS score FROM (SELECT query_id, unnest(t) AS term FROM q) JOIN w USING (term) GROUP BY ALL)) WHERE rank <= {TOP_N})"""
_SQL_FUSED = f"""
fused AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
          FROM (SELECT query_id, id, round(sum(part), 9) AS score FROM (SELECT query_id, id, 1.0::DOUBLE / (1 + rank) AS part FROM dense UNION ALL SELECT query_id, id, 1.0::DOUBLE / (1 + rank) FROM sparse) GROUP BY ALL)) WHERE rank <= {TOP_N})"""
_SQL_RERANKED = f"""
reranked AS (SELECT * FROM (SELECT query_id, id, score, fused_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank
             FROM (SELECT f.query_id, f.id, f.score, f.rank AS fused_rank, coalesce(round(len(list_intersect(q.t, p.t))::DOUBLE / nullif(len(q.t), 0), 6), 0) AS rerank_score
                   FROM fused f JOIN pts p ON p.id = f.id JOIN q ON q.query_id = f.query_id)) WHERE rank <= {TOP_K})"""


@query(f"WITH {_SQL_POINTS}, {_SQL_DENSE} SELECT query_id, id, score, rank::BIGINT AS rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-n of each query."""
    return _ranks(retrieval.dense_topk(_vectors(spark, sf_dir), _asked(spark, sf_dir), TOP_N))


@query(f"WITH {_SQL_POINTS}, {_SQL_WEIGHTS}, {_SQL_SPARSE} SELECT query_id, id, score, rank::BIGINT AS rank FROM sparse")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-n by the weights of shared terms."""
    return _ranks(retrieval.sparse_topk(_postings(_points(spark, sf_dir)), _asked(spark, sf_dir), TOP_N, pattern=text.ORACLE_TOKEN))


@query(f"WITH {_SQL_POINTS}, {_SQL_DENSE}, {_SQL_WEIGHTS}, {_SQL_SPARSE}, {_SQL_FUSED} SELECT query_id, id, score, rank::BIGINT AS rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists fused by reciprocal rank."""
    return _ranks(_fused(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, asked = _points(spark, sf_dir), _asked(spark, sf_dir)
    return retrieval.rrf(retrieval.dense_topk(_vectors(spark, sf_dir), asked, TOP_N), retrieval.sparse_topk(_postings(points), asked, TOP_N, pattern=text.ORACLE_TOKEN), TOP_N)


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_SQL_POINTS}, {_SQL_DENSE}, {_SQL_WEIGHTS}, {_SQL_SPARSE}, {_SQL_FUSED}, {_SQL_RERANKED} SELECT query_id, id, rank::BIGINT AS rank, fused_rank::BIGINT AS fused_rank, rerank_score FROM reranked")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates in the reranker's order; ties keep the fused order."""
    got = retrieval.rerank(_fused(spark, sf_dir), _points(spark, sf_dir), _asked(spark, sf_dir), TOP_K, pattern=text.ORACLE_TOKEN)
    return got.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.col("fused_rank").cast("bigint").alias("fused_rank"), "rerank_score")


@query(f"""WITH {_SQL_POINTS}, {_SQL_DENSE}, {_SQL_WEIGHTS}, {_SQL_SPARSE}, {_SQL_FUSED}, {_SQL_RERANKED}
SELECT query_id, rank::BIGINT AS rank, text, source_file, 0::BIGINT AS chunk_index, 1::BIGINT AS total_chunks, score, rerank_score FROM reranked JOIN pts USING (id)""")  # fmt: skip
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: dense and sparse recall, fusion, rerank, projection."""
    points = _points(spark, sf_dir)
    got = retrieval.search(points, _postings(points), _asked(spark, sf_dir), TOP_K, TOP_N, pattern=text.ORACLE_TOKEN, vectors=_vectors(spark, sf_dir))
    return got.withColumns({c: F.col(c).cast("bigint") for c in ("rank", "chunk_index", "total_chunks")})


@query(f"""WITH pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id), {_SQL_DENSE} SELECT query_id, id, score, rank::BIGINT AS rank FROM dense""")  # fmt: skip
def dense_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense_topk, over all embeddings, also those without a document."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return _ranks(retrieval.dense_topk(points, _asked(spark, sf_dir), TOP_N))


_CELLS = 16


@query(f"""WITH pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id), {_SQL_DENSE} SELECT query_id, id, score, rank::BIGINT AS rank FROM dense""")  # fmt: skip
def dense_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense top-n through the approximate index, with all cells probed, so that it is exact."""
    index = CellIndex(spark, _home(spark))
    index.build(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense")), _CELLS)
    return _ranks(index.search(_asked(spark, sf_dir), TOP_N, _CELLS))


@query(f"""WITH pts AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{text.ORACLE_TOKEN}') AS t FROM documents),
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{text.ORACLE_TOKEN}')) AS t FROM benchmark), {_SQL_WEIGHTS}, {_SQL_SPARSE} SELECT query_id, id, score, rank::BIGINT AS rank FROM sparse""")  # fmt: skip
def sparse_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As sparse_topk, without reading any vector."""
    points = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _ranks(retrieval.sparse_topk(_postings(points), asked, TOP_N, pattern=text.ORACLE_TOKEN))


@query(f"""WITH pts AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{text.ORACLE_TOKEN}') AS t FROM documents), {_SQL_WEIGHTS}
SELECT id, term, tf::BIGINT AS tf, dl::BIGINT AS length, round(weight, 6) AS weight FROM w""")  # fmt: skip
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse index: a row for each term of each document."""
    got = sparse.postings(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), pattern=text.ORACLE_TOKEN)
    return got.select("id", "term", "tf", F.col("length").cast("bigint").alias("length"), F.round("weight", 6).alias("weight"))


# ---- synchronisation: labelled documents are indexed, documents are on disk, pages have gone ------


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")  # hashed in the JVM: no need to deal texts out
    return docs.select(F.format_string("doc/%d", "doc_id").alias("file_path"), F.sha2("text", 256).alias("file_hash"), F.col("n_chars").cast("double").alias("file_mtime"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as last indexed: toxic ones at another time, low-quality ones with another hash."""
    docs, labels, pages = (tables.table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    known = docs.join(labels, "doc_id").select(
        F.format_string("doc/%d", "doc_id").alias("file_path"),
        F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise("stale").alias("file_hash"),
        (F.col("n_chars") - F.col("toxic") - (1 - F.col("quality"))).cast("double").alias("file_mtime"),
        F.ceil(F.col("n_chars") / 1000).cast("int").alias("chunk_count"))
    gone = pages.select(F.format_string("page/%d", "page_id").alias("file_path"), F.sha2("html", 256).alias("file_hash"), F.lit(0.0).alias("file_mtime"), F.lit(1).alias("chunk_count"))
    return known.unionByName(gone).withColumn("last_indexed_at", F.lit(0.0))


_SQL_SYNC = """
disk AS (SELECT 'doc/' || doc_id AS file_path, sha256(text) AS file_hash, n_chars::DOUBLE AS file_mtime FROM documents),
idx AS (SELECT 'doc/' || doc_id AS file_path, CASE WHEN quality = 1 THEN sha256(text) ELSE 'stale' END AS file_hash, (n_chars - toxic - (1 - quality))::DOUBLE AS file_mtime, ceil(n_chars / 1000.0)::INT AS chunk_count
        FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT 'page/' || page_id, sha256(html), 0.0, 1 FROM pages),
acts AS (SELECT coalesce(d.file_path, i.file_path) AS file_path, d.file_hash, d.file_mtime, i.file_hash AS old_hash,
         CASE WHEN i.file_path IS NULL THEN 'add' WHEN d.file_path IS NULL THEN 'delete' WHEN d.file_mtime = i.file_mtime THEN 'skip' WHEN d.file_hash = i.file_hash THEN 'touch' ELSE 'update' END AS action
         FROM disk d FULL OUTER JOIN idx i USING (file_path))"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two stages: listing first, hashes only for paths whose time differs."""
    docs = tables.table(spark, sf_dir, "documents").select(F.format_string("doc/%d", "doc_id").alias("file_path"), "text", F.col("n_chars").cast("double").alias("file_mtime"))
    first = diff.by_listing(docs.select("file_path", "file_mtime"), _index(spark, sf_dir))
    checked = first.filter("action IN ('add', 'check')").join(docs.select("file_path", "text"), "file_path").withColumn("file_hash", F.sha2("text", 256))
    settled = F.when(F.col("action") == "add", "add").when(F.col("file_hash") == F.col("old_hash"), "touch").otherwise("update")
    rest = first.filter("action NOT IN ('add', 'check')").withColumn("file_hash", F.lit(None).cast("string"))
    return checked.withColumn("action", settled).select("file_path", "mtime", "file_hash", "action").unionByName(rest.select("file_path", "mtime", "file_hash", "action"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("file_hash"))


@query(f"WITH {_SQL_SYNC} SELECT file_path, CASE WHEN action IN ('skip', 'touch', 'update') THEN CASE WHEN file_hash = old_hash THEN 'same' ELSE 'update' END ELSE action END AS action FROM acts")
def three_way_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add, delete or compare by hash alone, in one full outer join."""
    disk, known = _disk(spark, sf_dir), _index(spark, sf_dir)
    both = disk.alias("d").join(known.alias("i"), "file_path", "full_outer")
    action = diff.classify(F.col("d.file_hash").isNotNull(), F.col("i.file_hash").isNotNull(), F.lit(False), F.col("d.file_hash") == F.col("i.file_hash"))
    return both.select("file_path", F.when(action == "touch", "same").otherwise(action).alias("action"))


@query(f"WITH {_SQL_SYNC} SELECT file_path, action FROM acts")
def diff_with_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder sync's decision for each path: add, delete, update, touch or skip."""
    return _actions(spark, sf_dir).select("file_path", "action")


@query(f"WITH {_SQL_SYNC} SELECT file_path, action, row_number() OVER (ORDER BY file_path) - 1 AS place FROM acts WHERE action <> 'skip'")
def work_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is to do, in the order of paths."""
    return diff.ordered(_actions(spark, sf_dir).filter("action <> 'skip'").select("file_path", "action"))


@query(f"WITH {_SQL_SYNC} SELECT count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'delete') AS deleted FROM acts")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.stats(_actions(spark, sf_dir))


@query(f"""WITH {_SQL_SYNC} SELECT file_path, file_hash, file_mtime FROM disk
UNION ALL SELECT file_path, file_hash, file_mtime FROM idx WHERE file_path NOT IN (SELECT file_path FROM disk)""")  # fmt: skip
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(_index(spark, sf_dir).select("file_path", "file_hash", "file_mtime"), _disk(spark, sf_dir), "file_path")


@query(f"WITH {_SQL_SYNC} SELECT file_path, file_hash, file_mtime FROM idx WHERE file_path NOT IN (SELECT file_path FROM acts WHERE action = 'delete')")
def metadata_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _index(spark, sf_dir).select("file_path", "file_hash", "file_mtime")
    return delete(known, _actions(spark, sf_dir).filter("action = 'delete'"), "file_path")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src1'")
def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of one file out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return delete(docs, spark.createDataFrame([("src1",)], "source string"), "source")


@query("""SELECT doc_id, source, text FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)
UNION ALL SELECT page_id, 'src' || (page_id % 20), html FROM pages WHERE 'src' || (page_id % 20) IN (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)""")  # fmt: skip
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of changed files replaced by new ones, as one set operation."""
    docs, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    changed = docs.join(labels, "doc_id").filter("toxic = 1 AND quality = 0").select("source").distinct()
    new = pages.select(F.col("page_id").alias("doc_id"), F.format_string("src%d", F.col("page_id") % 20).alias("source"), F.col("html").alias("text"))
    return replace(docs.select("doc_id", "source", "text"), changed, new.join(changed, "source", "left_semi"), "source")


@query("""SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)""")
def point_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points replaced by id."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return upsert(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), "text"), "id")


@query("SELECT doc_id, source, text FROM documents WHERE source = 'src2' ORDER BY doc_id LIMIT 100")
def scroll_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one file's points, from a stored collection."""
    store = Store(spark, _home(spark), "kb")
    store.commit(0, points=table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_file"), F.col("doc_id").cast("int").alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("").alias("title"), "text", F.array().cast("array<float>").alias("dense")))
    return store.scroll("src2", 100).select(F.col("chunk_index").cast("bigint").alias("doc_id"), F.col("source_file").alias("source"), "text")


# ---- files and names ---------------------------------------------------------------------------

_EXT = "CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.TXT' WHEN 'fr' THEN '.pdf' ELSE '.log' END"
_PATH = f"CASE WHEN n_chars > 2000 THEN 'build/' WHEN n_chars > 1500 THEN '.git/' ELSE '' END || source || '/' || CASE WHEN n_chars < 300 THEN '.' ELSE '' END || 'f' || doc_id || {_EXT}"
_SPARK_PATH = f"concat(CASE WHEN n_chars > 2000 THEN 'build/' WHEN n_chars > 1500 THEN '.git/' ELSE '' END, source, '/', CASE WHEN n_chars < 300 THEN '.' ELSE '' END, 'f', doc_id, {_EXT})"


@query(f"SELECT doc_id, p AS rel_path FROM (SELECT doc_id, {_PATH} AS p FROM documents) WHERE NOT regexp_matches(p, '(^|/)\\.') AND NOT p LIKE '%.pdf' AND NOT p LIKE '%.log' AND NOT p LIKE 'build/%'")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden parts, suffix list, ignored suffixes and patterns."""
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SPARK_PATH).alias("rel_path"))
    return paths.filter(text.is_indexable(F.col("rel_path"), ["build/*"], [".LOG"]))


@query(f"SELECT doc_id, CASE WHEN n_chars < 300 THEN '.f' ELSE 'f' END || doc_id AS title, '[' || CASE WHEN n_chars < 300 THEN '.f' ELSE 'f' END || doc_id || ']' || chr(10) || text AS embed_input, lower({_EXT}) AS suffix FROM documents")
def title_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, suffix and the embedder's input."""
    d = table(spark, sf_dir, "documents").withColumn("p", F.expr(_SPARK_PATH))
    title = text.stem(F.col("p"))
    return d.select("doc_id", title.alias("title"), text.embed_input(title, F.col("text")).alias("embed_input"), text.suffix(F.col("p")).alias("suffix"))


@query("SELECT doc_id, regexp_replace(regexp_replace(t, '^\\s+', ''), '\\s+$', '') AS text FROM (SELECT doc_id, ' ' || chr(9) || text || chr(10) || ' ' AS t FROM documents)")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.stripped(F.concat(F.lit(" \t"), "text", F.lit("\n "))).alias("text"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(CASE WHEN n_chars % 3 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END, '\\S')")
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't blank; every third length has been made blank."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("n_chars") % 3 == 0, " \n\t").otherwise(F.col("text")))
    return docs.filter(~text.is_blank(F.col("text"))).select("doc_id")


@query("SELECT doc_id, sha256('kb' || chr(0) || source || chr(0) || doc_id) AS id FROM documents")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.point_id(F.lit("kb"), F.col("source"), F.col("doc_id")).alias("id"))


# ---- chunking ----------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{text.ORACLE_TOKEN}') AS t FROM documents),
s AS (SELECT doc_id, t, CASE WHEN len(t) = 0 THEN [] WHEN len(t) <= 256 THEN [0] ELSE range(0, len(t) - 32, 224) END AS s FROM t)
SELECT doc_id, (i - 1)::BIGINT AS chunk_index, len(s)::BIGINT AS total_chunks, array_to_string(t[s[i] + 1 : s[i] + 256], ' ') AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s)""")  # fmt: skip
def token_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chunking.token_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "total_chunks")})


_W = "[\\p{L}\\p{N}_]+"
# Windows that are slices of the text: from a word's start to the end of the 256th from it.
_SQL_SLICES = f"""
d AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS w, string_split_regex(text, '{_W}') AS g FROM documents WHERE regexp_matches(text, '\\S')),
o AS (SELECT doc_id, list(pos ORDER BY k) AS a, list(pos + size ORDER BY k) AS e FROM (
      SELECT doc_id, k, size, (sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k) - size)::BIGINT AS pos
      FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, length(unnest(w)) AS size, length(unnest(g[1:len(w)])) AS gap FROM d WHERE len(w) > 256)) GROUP BY doc_id),
s AS (SELECT d.doc_id, text, a, e, CASE WHEN a IS NULL THEN [0] ELSE range(0, len(a) - 32, 224) END AS s FROM d LEFT JOIN o USING (doc_id)),
slices AS (SELECT doc_id, (i - 1)::BIGINT AS chunk_index, len(s)::BIGINT AS total_chunks,
           CASE WHEN a IS NULL THEN text ELSE substr(text, a[s[i] + 1] + 1, e[least(s[i] + 256, len(a))] - a[s[i] + 1]) END AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s))"""


@query(f"WITH {_SQL_SLICES} SELECT * FROM slices")
def char_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of words as slices of the text, as files that aren't Markdown are cut."""
    got = chunking.char_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "total_chunks")})


def _markdown(docs: DataFrame) -> DataFrame:
    """A Markdown text of each document: every third line a heading, all lines apart."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda s: s.rlike(r"\S")), lambda s, i: F.concat(F.when(i % 3 == 0, F.lit("## ")).otherwise(F.lit("w ")), s))
    return docs.select("doc_id", F.array_join(lines, "\n\n").alias("text"))


_SQL_LINES = "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\\S')) AS l FROM documents"


# Each line becomes a block of the kind of its number, so that all kinds follow each other; {s} is the line.
_KINDS = (
    ("heading", "'## ' || {s}"), ("paragraph", "'w ' || {s}"), ("fence", "'```x' || chr(10) || 'w ' || {s} || chr(10) || chr(10) || '````'"), ("math", "'$$' || chr(10) || 'w ' || {s} || chr(10) || '$$'"),
    ("table", "'| ' || {s} || chr(10) || '| - |'"), ("quote", "'> ' || {s} || chr(10) || '> more'"), ("rule", "'* * *'"), ("list", "'- ' || {s} || chr(10) || chr(10) || '  more' || chr(10) || '2) more'"),
    ("image", "'![a](b)'"), ("underlined", "'w ' || {s} || chr(10) || '==='"),
)
_FRONT = "'---' || chr(10) || 'a: b' || chr(10) || '---'"


def _by_kind(number: str, values: list[str]) -> str:
    return f"CASE {' '.join(f'WHEN {number} % {len(values)} = {k} THEN {v}' for k, v in enumerate(values))} END"


@query(f"""WITH l AS ({_SQL_LINES}), b AS (SELECT doc_id, i, l[i] AS s FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l))
SELECT doc_id, 0::BIGINT AS block_index, 'frontmatter' AS kind, {_FRONT} AS text FROM documents
UNION ALL SELECT doc_id, i::BIGINT, {_by_kind("(i - 1)", [f"'{k}'" for k, _ in _KINDS])}, {_by_kind("(i - 1)", [v.format(s="s") for _, v in _KINDS])} FROM b""")  # fmt: skip
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all kinds."""
    lines = f"transform(filter(split(text, '\\n'), s -> s rlike '\\\\S'), (s, i) -> {_by_kind('i', [v.format(s='s') for _, v in _KINDS])})"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.concat(F.array(F.expr(_FRONT)), F.expr(lines)), "\n\n").alias("text"))
    return chunking.markdown_blocks(docs).withColumn("block_index", F.col("block_index").cast("bigint"))


# With headings at 0, 3, 6, ... a window of four blocks begins at each of them, takes in
# the body after a heading it would end on, and is the last one if it reaches the end.
_SQL_MD_CHUNKS = f"""
b AS (SELECT doc_id, list_transform(l, lambda s, i: CASE WHEN (i - 1) % 3 = 0 THEN '## ' ELSE 'w ' END || s) AS b, len(l) AS n FROM ({_SQL_LINES}) WHERE len(l) > 0),
w AS (SELECT doc_id, b, n, list_filter(range(0, n, 3), lambda s: s = 0 OR s + 2 < n) AS starts FROM b),
md AS (SELECT doc_id, (i - 1)::BIGINT AS chunk_index, len(starts)::BIGINT AS total_chunks, array_to_string(b[starts[i] + 1 : CASE WHEN starts[i] + 4 < n THEN starts[i] + 5 ELSE n END], chr(10) || chr(10)) AS text
       FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM w))"""


@query(f"WITH {_SQL_MD_CHUNKS} SELECT * FROM md")
def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chunking.markdown_chunks(_markdown(table(spark, sf_dir, "documents")))
    return got.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "total_chunks")})


@query("""SELECT doc_id, (i - 1)::BIGINT AS line, CASE WHEN NOT regexp_matches(s, '\\S') THEN 'blank' WHEN regexp_matches(s, '^#{1,6}(\\s|$)') THEN 'heading' WHEN regexp_matches(s, '^(```+|~~~+)') THEN 'fence' WHEN s = '$$' THEN 'math'
WHEN starts_with(s, '|') THEN 'table' WHEN starts_with(s, '>') THEN 'quote' WHEN regexp_matches(s, '^[-*_](\\s*[-*_]){2,}\\s*$') THEN 'rule' WHEN regexp_matches(s, '^([-*+•·–—▪▸◦]|\\d+[.)]) ') THEN 'list'
WHEN regexp_matches(s, '^!\\[{1,2}[^\\]]*\\]{1,2}(\\([^)]*\\))?$') THEN 'image' ELSE 'text' END AS kind
FROM (SELECT doc_id, i, CASE (i - 1) % 5 WHEN 0 THEN '## ' WHEN 1 THEN '- ' WHEN 2 THEN '> ' ELSE '' END || trim(l[i]) AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")  # fmt: skip
def md_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of block each line would begin."""
    mark = lambda i: F.when(i % 5 == 0, "## ").when(i % 5 == 1, "- ").when(i % 5 == 2, "> ").otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(mark(i), F.trim(s)))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return chunking.line_kinds(docs).withColumn("line", F.col("line").cast("bigint"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: even ones Markdown, odd ones text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = lambda suffix: F.format_string(f"doc/%d{suffix}", "doc_id").alias("file_path")
    return _markdown(docs.filter("doc_id % 2 = 0")).select(path(".md"), "text").unionByName(docs.filter("doc_id % 2 = 1").select(path(".txt"), "text"))


_SQL_DISPATCH = f"""{_SQL_MD_CHUNKS}, {_SQL_SLICES},
cut AS (SELECT 'doc/' || doc_id || '.md' AS source_file, doc_id, chunk_index, total_chunks, text FROM md WHERE doc_id % 2 = 0
        UNION ALL SELECT 'doc/' || doc_id || '.txt', doc_id, chunk_index, total_chunks, text FROM slices WHERE doc_id % 2 = 1)""".replace("\ns AS (", "\nst AS (").replace("AS i FROM s))", "AS i FROM st))")


@query(f"WITH {_SQL_DISPATCH} SELECT source_file, chunk_index, total_chunks, text FROM cut")
def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files by headings, all others by windows."""
    got = chunking.chunk_files(_files(spark, sf_dir))
    return got.select(F.col("file_path").alias("source_file"), F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), "text")


@query(f"""WITH {_SQL_DISPATCH} SELECT sha256('kb' || chr(0) || source_file || chr(0) || chunk_index) AS id, source_file, chunk_index, total_chunks, doc_id::VARCHAR AS title, text FROM cut""")
def point_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that files become."""
    got = points_of(_files(spark, sf_dir), "kb", Settings(HashingEmbedder(8)))
    return got.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "total_chunks")}).drop("dense")


@query("SELECT conv_id AS source_file, count(*) AS n_chunks, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def doc_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chunking.reconstruct(turns.select(F.col("conv_id").alias("source_file"), F.col("turn").alias("chunk_index"), "text"))


@query("""WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n FROM documents WHERE regexp_matches(text, '\\S'))
SELECT doc_id, greatest(1, ceil((n - 32) / 224.0))::BIGINT AS n_chunks, doc_id % 7 <> 0 OR n <= 256 AS complete,
CASE WHEN n <= 256 THEN text WHEN doc_id % 7 <> 0 THEN regexp_replace(regexp_replace(text, '^[^\\p{L}\\p{N}_]+', ''), '[^\\p{L}\\p{N}_]+$', '') END AS text
FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 AND n > 256 THEN n - 224 ELSE n END AS m, n FROM d)""".replace("(n - 32)", "(m - 32)"))
def doc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into windows of words and put together again; every seventh has lost its last window."""
    cut = chunking.char_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = cut.filter("doc_id % 7 <> 0 OR total_chunks = 1 OR chunk_index < total_chunks - 1")
    return chunking.reconstruct(left, key="doc_id", overlap=chunking.CHUNK_OVERLAP, total="total_chunks")


@query("SELECT doc_id // 64 AS batch, count(*) AS texts, sum(n_chars)::BIGINT AS chars, count(*) FILTER (regexp_matches(text, '\\S')) AS embedded FROM documents GROUP BY 1")
def batch_embed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts embedded; how many of each 64 got a unit vector, which those with a word do."""
    docs = table(spark, sf_dir, "documents").withColumn("v", HashingEmbedder(64).column(F.col("text")))
    unit = F.sum(F.when(F.abs(vectors.norm(F.col("v")) - 1) < 1e-3, 1).otherwise(0)).cast("bigint")
    return docs.groupBy(F.floor(F.col("doc_id") / 64).alias("batch")).agg(F.count("*").alias("texts"), F.sum("n_chars").alias("chars"), unit.alias("embedded"))


@query("SELECT item_id, true AS same FROM benchmark")
def query_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query is embedded as a passage with its words is."""
    embedder = HashingEmbedder(64)
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", (embedder.column(F.col("text"), is_query=True) == embedder.column(F.concat(F.lit("  "), "text", F.lit("\n")))).alias("same"))


# ---- status ------------------------------------------------------------------------------------


@query("SELECT source AS collection, count(*) AS indexed_files, sum(ceil(n_chars / 1000.0))::BIGINT AS total_chunks FROM documents GROUP BY source")
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.ceil(F.col("n_chars") / 1000).alias("chunk_count"))
    return stats.status(files, "collection")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("event_id").cast("string").alias("file_path"), (F.col("value") > 50).alias("in_progress"))


@query("""SELECT name AS collection, coalesce(f, 0)::BIGINT AS indexed_files, coalesce(c, 0)::BIGINT AS total_chunks, coalesce(p, 0)::BIGINT AS pending_tasks, (SELECT count(*) FROM events)::BIGINT AS total_pending
FROM (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'empty' UNION SELECT DISTINCT source FROM documents)
LEFT JOIN (SELECT source, count(*) AS f, sum(ceil(n_chars / 1000.0)) AS c FROM documents GROUP BY source) ON source = name
LEFT JOIN (SELECT event_type, count(*) AS p FROM events GROUP BY event_type) ON event_type = name""")  # fmt: skip
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("collection"), F.ceil(F.col("n_chars") / 1000).alias("chunk_count"))
    tasks = _tasks(spark, sf_dir)
    names = tasks.select(F.col("collection").alias("name")).union(docs.select("source")).union(spark.createDataFrame([("empty",)], "name string")).distinct()
    return stats.health(names, files, tasks)


@query("SELECT event_type AS collection, count(*) AS pending, count(*) FILTER (NOT value > 50) AS queued, count(*) FILTER (value > 50) AS in_progress FROM events GROUP BY 1")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.task_status(_tasks(spark, sf_dir))


@query("""SELECT DISTINCT event_type AS collection, user_id::VARCHAR AS file_path FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = e.event_type AND p.event_id = e.user_id)""")
def enqueue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tasks that are accepted: each once, none that is pending."""
    new = table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("user_id").cast("string").alias("file_path"))
    return stats.enqueue(_tasks(spark, sf_dir), new)


@query("SELECT count(*) FILTER (NOT value > 50) AS removed, count(*) FILTER (value > 50) AS in_progress FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def cancel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    return stats.cancel(tasks, tasks.agg(F.min("collection")).first()[0])[1]


@query("SELECT event_type AS collection, event_id::VARCHAR AS file_path, value > 50 AS in_progress FROM events WHERE value > 50 OR event_type <> (SELECT min(event_type) FROM events)")
def cancel_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that are left when a collection's waiting ones are cancelled."""
    tasks = _tasks(spark, sf_dir)
    return stats.cancel(tasks, tasks.agg(F.min("collection")).first()[0])[0]


@query("SELECT 0::BIGINT AS doc_id, coalesce(max(ceil(n_chars / 1000.0)), 0)::BIGINT AS chunk_count FROM documents WHERE doc_id = 0 UNION ALL SELECT -1, 0")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a known and of an unknown file."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.ceil(F.col("n_chars") / 1000).alias("chunk_count"))
    return stats.chunk_count(files, "0").select(F.lit(0).cast("bigint").alias("doc_id"), "chunk_count").union(stats.chunk_count(files, "-1").select(F.lit(-1).cast("bigint"), "chunk_count"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, max(value) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95, max(value) FILTER (i = floor(n * 0.99::DOUBLE)) AS p99, min(value) AS min, max(value) AS max FROM r GROUP BY event_type""")  # fmt: skip
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


def _home(spark: SparkSession) -> str:
    """A new folder, with its scheme, in the shared one."""
    return f"{shared_dir(spark)}/home-{uuid.uuid4().hex}"


def _local_home(spark: SparkSession) -> str:
    """The same as a bare path, for folders of files, where the shared folder is a POSIX mount."""
    where = _home(spark)
    if where.startswith("file:"):
        where = "/" + where.removeprefix("file:").lstrip("/")
    os.makedirs(where)
    return where


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- tasks from events ---------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'error' THEN 'fail' ELSE 'finish' END"


@query(f"""WITH e AS (SELECT user_id AS task, {_KIND} AS kind, epoch_us(ts) / 1e6 AS since, event_id FROM events),
l AS (SELECT task, arg_max(kind, event_id) AS kind, arg_max(since, event_id) AS since FROM e GROUP BY task)
SELECT task, CASE WHEN kind = 'enqueue' THEN 'waiting' WHEN kind = 'claim' AND since + 86400 > (SELECT max(since) FROM e) THEN 'held' WHEN kind = 'claim' THEN 'waiting' WHEN kind = 'fail' THEN 'failed' ELSE 'done' END AS state FROM l""")  # fmt: skip
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what happened to each user's task; its state at the last event, claims running out after a day."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.expr(_KIND).alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("place"))
    now = events.agg(F.max("at")).first()[0]
    return tasks.states(events, now, 86_400.0).select("task", "state")


# ---- names, bytes, files, logs and collections, made from the tables ------------------------------

_NAME = "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '@' || page_id WHEN 2 THEN 'p-' || page_id WHEN 3 THEN 'p ' || page_id ELSE regexp_replace(url, '[^a-z0-9]', '', 'g') || repeat('x', (page_id % 80)::INT) END"
_SPARK_NAME = "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('@', page_id) WHEN 2 THEN concat('p-', page_id) WHEN 3 THEN concat('p ', page_id) ELSE concat(regexp_replace(url, '[^a-z0-9]', ''), repeat('x', cast(page_id % 80 AS int))) END"


@query(f"""SELECT page_id, CASE WHEN name = '' THEN 'name is empty' WHEN length(name) > 64 THEN 'name is longer than 64 characters'
WHEN NOT regexp_full_match(name, '[a-zA-Z0-9][a-zA-Z0-9_-]*') THEN 'name may hold letters, digits, _ and -, and begins with a letter or digit'
WHEN name = 'p-7' THEN 'name is taken' WHEN url LIKE '%page=2%' AND page_id = 12 THEN 'folder is taken' END AS error FROM (SELECT page_id, url, {_NAME} AS name FROM pages)""")  # fmt: skip
def name_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a name and folder made from each page break."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_SPARK_NAME).alias("name"), F.when(F.col("url").contains("page=2"), F.format_string("/p%d", "page_id")).otherwise("/other").alias("folder"))
    return pages.select("page_id", text.name_error(F.col("name"), F.col("folder"), ["p-7"], ["/p12"]).alias("error"))


def _damaged(docs: DataFrame) -> DataFrame:
    """(doc_id, content): lines of even lengths end as on other systems, every third text ends in a byte that isn't UTF-8."""
    lines = F.when(F.col("n_chars") % 2 == 0, F.regexp_replace("text", "\n", "\r\n")).otherwise(F.col("text"))
    return docs.select("doc_id", F.when(F.col("n_chars") % 3 == 0, F.concat(lines.cast("binary"), F.lit(b"\xff"))).otherwise(lines.cast("binary")).alias("content"))


_REPAIRED = "text || CASE WHEN n_chars % 3 = 0 THEN chr(65533) ELSE '' END"


@query(f"SELECT doc_id, {_REPAIRED} AS text FROM documents")
def utf8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends and invalid bytes of damaged documents."""
    return _damaged(table(spark, sf_dir, "documents")).select("doc_id", text.repaired(F.col("content")).alias("text"))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY quality, toxic) - 1 AS k, quality, toxic FROM (SELECT DISTINCT quality, toxic FROM labels))
SELECT k * 2 AS step, k > 0 AS changed FROM s UNION ALL SELECT k * 2 + 1, false FROM s""")  # fmt: skip
def model_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature for each pair of labels, looked at twice: a new one counts as a change, but for the first."""
    catalog, rows = Catalog(spark, _home(spark)), []
    for q, t in table(spark, sf_dir, "labels").select("quality", "toxic").distinct().orderBy("quality", "toxic").collect():  # four pairs at most
        for _ in range(2):
            rows.append((len(rows), catalog.model_changed(f"q{q}", f"t{t}")[0]))
            catalog.save_signature(f"q{q}", f"t{t}")
    return _rows(spark, rows, "step bigint, changed boolean")


def _home(spark: SparkSession) -> str:
    """A new folder, with its scheme, in the shared one."""
    return f"{shared_dir(spark)}/home-{uuid.uuid4().hex}"


def _local_home(spark: SparkSession) -> str:
    """The same as a bare path, for folders of files, where the shared folder is a POSIX mount."""
    where = bare(spark, _home(spark))
    os.makedirs(where)
    return where


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _as_files(docs: DataFrame, folder: str, path: str = "concat(source, '/', doc_id, '.txt')", content: str = "text", mtime: str = "n_chars") -> int:
    """Each document as a file below a folder, its length as its time."""
    return write_files(docs.select(F.expr(path).alias("rel_path"), F.expr(content).alias("content"), F.expr(mtime).cast("double").alias("at")), folder, mtime="at")


@query(f"""SELECT p AS rel_path, strlen(text)::BIGINT AS size, n_chars::DOUBLE AS file_mtime FROM (SELECT *, {_PATH} AS p FROM documents)
WHERE NOT regexp_matches(p, '(^|/)\\.') AND NOT p LIKE '%.pdf' AND NOT p LIKE '%.TXT' AND NOT p LIKE 'build/%'""")  # fmt: skip
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files, and listed without links, hidden ones, other suffixes and ignored patterns."""
    home = _local_home(spark)
    folder = os.path.join(home, "docs")
    docs = table(spark, sf_dir, "documents")
    _as_files(docs, folder, _SPARK_PATH)
    os.symlink(os.path.join(folder, "build"), os.path.join(folder, "linked"))
    first = docs.agg(F.min(F.expr(_SPARK_PATH))).first()[0]
    os.symlink(os.path.join(folder, first), os.path.join(folder, "link.md"))
    return list_folder(spark, folder, ["build/*"], [".txt"]).select("rel_path", "size", "file_mtime")


@query(f"""SELECT doc_id, {_REPAIRED} AS text, n_chars % 3 <> 0 AND n_chars % 2 <> 0 AS same_hash, true AS found FROM documents
UNION ALL SELECT -1 - page_id, NULL, NULL, false FROM pages""")  # fmt: skip
def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and repaired texts of damaged documents as files, and of files that have gone. The hash is that of the
    text where nothing was damaged (lines too, so texts without line ends are left out of the comparison)."""
    folder = os.path.join(_local_home(spark), "docs")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    write_files(_damaged(docs).select(F.format_string("%d.txt", "doc_id").alias("rel_path"), "content"), folder)
    there = docs.select("doc_id", F.concat(F.lit(f"{folder}/"), "doc_id", F.lit(".txt")).alias("file_path"))
    gone = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.concat(F.lit(f"{folder}/page"), "page_id", F.lit(".txt")).alias("file_path"))
    read = with_content(there.unionByName(gone))
    plain = docs.select(F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_hash"), (~F.col("text").contains("\n")).alias("_one"), "n_chars")
    both = read.join(plain, F.col("doc_id") == F.col("_id"), "left")
    # a text of one line has no line end to damage
    same = (F.col("file_hash") == F.col("_hash")) & ~(F.col("_one") & (F.col("n_chars") % 2 == 0))
    return both.select("doc_id", "text", F.when(F.col("found"), same).alias("same_hash"), "found")


_SQL_LINE = "event_type || ' of ' || user_id || ': ' || event_id"


@query(f"""WITH l AS (SELECT event_type || '.log' AS name, event_id, {_SQL_LINE} AS line, (event_id % 2)::INT AS step FROM events),
s AS (SELECT name, step, string_agg(line, '|' ORDER BY event_id) AS lines, sum(strlen(line) + 1)::BIGINT AS size FROM l GROUP BY ALL)
SELECT name, step, sum(size) OVER (PARTITION BY name ORDER BY step)::BIGINT AS position, lines FROM s""")  # fmt: skip
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a log for each type: half of them, then the other half; what is new each time."""
    home, out = _local_home(spark), None
    line = F.concat("event_type", F.lit(" of "), "user_id", F.lit(": "), "event_id").alias("line")
    events = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(".log")).alias("name"), "event_id", line, (F.col("event_id") % 2).alias("step"))
    files = events.select("name", F.concat(F.lit(f"{home}/"), "name").alias("path"), F.lit(0).cast("bigint").alias("position")).distinct()
    for step in range(2):
        # the log so far; a log in this query is as long as the events of one type
        logs = events.filter(F.col("step") <= step).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("step", "event_id", "line"))).alias("l"))
        write_files(logs.select("name", F.concat(F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("content")), home, path="name")
        read = materialise(tail(files), "tail")
        rows = read.select("name", F.lit(step).alias("step"), "position", F.array_join("lines", "|").alias("lines"))
        out = rows if out is None else out.unionByName(rows)
        files = read.select("name", "path", "position")
    return out


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'low' ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1
UNION ALL SELECT -1 - item_id, text FROM benchmark""")  # fmt: skip
def store_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stored collection; labels as changes, one version for those that go, one for those that become
    others, one for new ones; merged; a version overtaken, one broken and the old ones cleaned away."""
    store = Store(spark, _home(spark), "kb", fan=3)
    docs, marks, items = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    point = lambda df: df.select(F.col("doc_id").cast("string").alias("id"), F.format_string("doc/%d", "doc_id").alias("source_file"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("").alias("title"), "text", F.array().cast("array<float>").alias("dense"))
    marked = lambda rule: docs.join(marks.filter(rule).select("doc_id"), "doc_id", "left_semi")
    store.create()
    store.commit(1, points=point(docs))
    bad, low = point(marked("toxic = 1")), point(marked("toxic = 0 AND quality = 0").withColumn("text", F.lit("low")))
    store.change(2, points=(bad.select("source_file"), bad.limit(0)))
    try:
        store.change(2, points=(bad.select("source_file"), bad))
        raise AssertionError("a version was overtaken and not refused")
    except ConcurrentWrite:
        pass
    store.change(3, points=(low.select("source_file"), low))
    store.compact()
    new = point(items.select((-1 - F.col("item_id")).alias("doc_id"), "text"))
    store.change(store.version(), points=(new.select("source_file"), new))
    store.files.create(os.path.join(store.path, "versions", f"{store.version() + 1}.json"), "{")
    store.vacuum(1)
    return store.read("points").select(F.col("id").cast("bigint").alias("doc_id"), "text")


@query("""WITH s AS (SELECT source AS name, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents))
SELECT name, 0::BIGINT AS round, CASE WHEN k > 4 THEN 'there are 4 collections already' END AS error FROM s
UNION ALL SELECT name, 1, CASE WHEN k = 1 THEN NULL WHEN k <= 4 THEN 'name is taken' ELSE 'there are 4 collections already' END FROM s""")  # fmt: skip
def registry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source registered as a collection, and again after the first has gone: four have room."""
    catalog, rows = Catalog(spark, _home(spark)), []
    names = [r.source for r in table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").collect()]  # the catalogue takes four
    for turn in range(2):
        if turn:
            catalog.unregister(names[0])
        for name in names:
            try:
                catalog.register(name, f"/{name}")
                rows.append((name, turn, None))
            except ValueError as e:
                rows.append((name, turn, str(e)))
    return _rows(spark, rows, "name string, round bigint, error string")


@query("""SELECT n_nationkey AS nation, (n_nationkey - 3) / 20.0::DOUBLE AS w_dense, n_regionkey / 2.0::DOUBLE AS w_sparse, n_nationkey - 5 AS top_k,
n_nationkey >= 6 AND (n_nationkey - 3) / 20.0 <= 1 AND n_regionkey <= 2 AS accepted FROM nation""")  # fmt: skip
def search_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and numbers of results made from nations: weights lie between 0 and 1, and numbers are positive."""
    points = spark.createDataFrame([], POINTS)
    asked = spark.createDataFrame([], "query_id bigint, text string, dense array<float>")
    rows = []
    for nation, region in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():  # options are the driver's
        wd, ws, k = (nation - 3) / 20, region / 2, nation - 5
        try:
            retrieval.search(points, spark.createDataFrame([], POSTINGS), asked, top_k=k, w_dense=wd, w_sparse=ws)
            rows.append((nation, wd, ws, k, True))
        except ValueError:
            rows.append((nation, wd, ws, k, False))
    return _rows(spark, rows, "nation bigint, w_dense double, w_sparse double, top_k bigint, accepted boolean")


def _engine(spark: SparkSession, home: str, dim: int = 8):
    from lodestar.service import Engine

    return Engine(spark, os.path.join(home, "engine"), Settings(HashingEmbedder(dim)))


def _counts(rows: list[tuple]) -> str:
    """SQL of rows (step, what, number), of which the numbers are SQL."""
    return f"WITH {_SQL_SLICES}, lab AS (SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id))\n" + "\nUNION ALL ".join(f"SELECT {k}::BIGINT AS step, '{what}' AS what, ({number})::BIGINT AS n" for k, (what, number) in enumerate(rows))


_DOCS, _CHUNKS, _TOXIC, _LOW, _PAGES = "SELECT count(*) FROM documents", "SELECT count(*) FROM slices", "SELECT count(*) FROM lab WHERE toxic = 1", "SELECT count(*) FROM lab WHERE toxic = 0 AND quality = 0", "SELECT count(*) FROM pages"


def _noted(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return _rows(spark, [(k, *r) for k, r in enumerate(rows)], "step bigint, what string, n bigint")


@query(_counts([("added", _DOCS), ("updated", "0"), ("deleted", "0"), ("added", _PAGES), ("updated", _LOW), ("deleted", _TOXIC), ("added", "0"), ("updated", "0"), ("deleted", "0"), ("files", f"({_DOCS}) - ({_TOXIC}) + ({_PAGES})")]))
def folder_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a folder: indexed; then toxic ones removed, low ones changed and pages added; then as it is."""
    home = _local_home(spark)
    folder, engine = os.path.join(home, "docs"), _engine(spark, home)
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    _as_files(docs, folder)
    counts = [engine.add("kb", folder)]
    _as_files(docs.join(marks.filter("toxic = 0 AND quality = 0").select("doc_id"), "doc_id", "left_semi"), folder, content="concat(text, ' more')", mtime="n_chars + 1")
    _removed(docs.join(marks.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi"), folder)
    write_files(table(spark, sf_dir, "pages").select(F.format_string("pages/%d.html", "page_id").alias("rel_path"), F.col("html").alias("content")), folder)
    counts += [engine.sync("kb"), engine.sync("kb")]
    return _noted(spark, [(what, c[what]) for c in counts for what in ("added", "updated", "deleted")] + [("files", engine.store("kb").read("files").count())])


def _removed(docs: DataFrame, folder: str) -> None:
    """Remove the files of documents, in the tasks that hold these."""

    def remove(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                with contextlib.suppress(FileNotFoundError):
                    os.remove(os.path.join(folder, p))
            yield batch

    docs.select(F.expr("concat(source, '/', doc_id, '.txt')").alias("p")).mapInArrow(remove, "p string").count()


@query(_counts([("files", _DOCS), ("points", _CHUNKS), ("files", _DOCS), ("points", _CHUNKS), ("files", "0"), ("points", "0"), ("files", "0"), ("points", "0")]))
def collection_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of all documents made, built anew and removed; one whose folder is missing leaves nothing."""
    home = _local_home(spark)
    folder, engine, rows = os.path.join(home, "docs"), _engine(spark, home), []
    _as_files(table(spark, sf_dir, "documents"), folder)

    def note(name: str) -> None:
        rows.extend((what, engine.store(name).read(what).count()) for what in ("files", "points"))

    engine.add("kb", folder)
    note("kb")
    engine.rebuild("kb")
    note("kb")
    with contextlib.suppress(ValueError):
        engine.add("other", os.path.join(home, "absent"))
    note("other")
    engine.remove("kb")
    note("kb")
    return _noted(spark, rows)


@query(_counts([("first", _DOCS), ("of 8", _CHUNKS), ("same model", "0"), ("of 8", _CHUNKS), ("other model", _DOCS), ("of 16", _CHUNKS), ("same model", "0"), ("of 16", _CHUNKS)]))
def model_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of all documents is built anew when the embedder is another one; vectors by their length."""
    home = _local_home(spark)
    folder, engine, rows = os.path.join(home, "docs"), _engine(spark, home), []
    _as_files(table(spark, sf_dir, "documents"), folder)
    engine.restore()

    def note(what: str, counts: dict) -> None:
        dim = engine.settings.embedder.dim
        rows.extend([(what, counts["added"]), (f"of {dim}", engine.store("kb").read("points").filter(F.size("dense") == dim).count())])

    note("first", engine.add("kb", folder))
    note("same model", engine.restore()["kb"])
    engine.settings.embedder = HashingEmbedder(16)
    note("other model", engine.restore()["kb"])
    note("same model", engine.restore()["kb"])
    return _noted(spark, rows)


@query(_counts([("accepted", _TOXIC), ("pending", "0"), ("files", _TOXIC), ("added", f"({_DOCS}) - ({_TOXIC})"), ("files", _DOCS)]))
def task_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents of a folder indexed as tasks, each asked for twice; then the rest by a sync."""
    home = _local_home(spark)
    folder, engine = os.path.join(home, "docs"), _engine(spark, home)
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    os.makedirs(folder)
    engine.add("kb", folder)
    _as_files(docs, folder)
    paths = [os.path.join(folder, r.p) for r in docs.join(marks.filter("toxic = 1"), "doc_id", "left_semi").select(F.expr("concat(source, '/', doc_id, '.txt')").alias("p")).collect()]
    rows = [("accepted", engine.enqueue("kb", paths + paths))]
    while not engine.wait("kb", 600):  # however long the tasks take
        pass
    files = lambda: ("files", engine.store("kb").read("files").count())
    rows += [("pending", engine.tasks("kb")["pending_tasks"]), files(), ("added", engine.sync("kb")["added"]), files()]
    return _noted(spark, rows)


@query(_counts([("error", "1"), ("added", _PAGES), ("deleted", _TOXIC)]))
def poll_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of all documents polled as a stream: a beat fails, the next ones find new pages and lost documents."""
    home = _local_home(spark)
    folder, engine, calls = os.path.join(home, "docs"), _engine(spark, home), []
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    _as_files(docs, folder)
    engine.add("kb", folder)

    def beat() -> dict:
        calls.append(1)
        if len(calls) > 3:  # the result has three beats
            return {}
        if len(calls) == 1:
            raise RuntimeError("out of reach")
        if len(calls) == 2:
            write_files(table(spark, sf_dir, "pages").select(F.format_string("pages/%d.html", "page_id").alias("rel_path"), F.col("html").alias("content")), folder)
        elif len(calls) == 3:
            _removed(docs.join(marks.filter("toxic = 1"), "doc_id", "left_semi"), folder)
        return engine.sync("kb")

    watcher = Watcher(spark, "kb", beat, 1)
    watcher.start()
    try:
        while len(watcher.beats) < 3 and watcher.running:  # however long the folder takes
            time.sleep(0.2)
    finally:
        watcher.stop()
    return _noted(spark, [("error", 1) if "error" in b else next((k, v) for k, v in b.items() if v) for b in list(watcher.beats)[:3]])


@query(_counts([("added", _PAGES), ("updated", _LOW), ("deleted", _TOXIC), ("errors", "0"), ("files", f"({_DOCS}) - ({_TOXIC}) + ({_PAGES})")]))
def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of all documents as a stream of listings, while pages are added, low documents changed and toxic ones
    removed; what its batches gave together, however many there were."""
    home = _local_home(spark)
    folder, engine = os.path.join(home, "docs"), _engine(spark, home)
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marked = lambda rule: docs.join(marks.filter(rule).select("doc_id"), "doc_id", "left_semi")
    _as_files(docs, folder)
    engine.add("kb", folder)
    engine.poll_seconds = 1
    watcher = engine.watch("kb")
    try:
        write_files(table(spark, sf_dir, "pages").select(F.format_string("pages/%d.html", "page_id").alias("rel_path"), F.col("html").alias("content")), folder)
        _as_files(marked("toxic = 0 AND quality = 0"), folder, content="concat(text, ' more')", mtime="n_chars + 1")
        _removed(marked("toxic = 1"), folder)
        total = lambda what: sum(b.get(what, 0) for b in list(watcher.beats))
        there, low, seen = list_folder(spark, folder).count(), marked("toxic = 0 AND quality = 0").count(), -1
        while watcher.running:  # however long the batches take; only a batch changes the collection
            if len(watcher.beats) != seen:
                seen = len(watcher.beats)
                if total("updated") >= low and engine.store("kb").read("files").count() == there:
                    break
            time.sleep(1)
    finally:
        watcher.stop()
    rows = [(what, total(what)) for what in ("added", "updated", "deleted")] + [("errors", sum("error" in b for b in watcher.beats))]
    return _noted(spark, [*rows, ("files", engine.store("kb").read("files").count())])


@query(_counts([("collections", "1"), ("indexed_files", _DOCS), ("total_chunks", _CHUNKS), ("watching", "0"), ("pending_tasks", "0"), ("results", f"least(5, ({_DOCS}))"), ("refused", "1")]))
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints as JSON about a collection of all documents."""
    from lodestar.cli import main

    home = _local_home(spark)
    folder, engine = os.path.join(home, "docs"), _engine(spark, home)
    _as_files(table(spark, sf_dir, "documents"), folder)

    def said(*args: str) -> dict:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            main(list(args), engine)
        return json.loads(out.getvalue())

    said("kb", "add", "kb", folder)
    status = said("collection", "status", "kb")
    asked = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    rows = [("collections", len(said("kb", "list")["collections"])), *((k, int(status[k])) for k in ("indexed_files", "total_chunks", "watching"))]
    rows += [("pending_tasks", said("collection", "tasks", "kb")["pending_tasks"]), ("results", len(said("search", "kb", asked, "--top-k", "5")["results"]))]
    rows.append(("refused", int("no such collection" in said("collection", "sync", "x")["error"])))
    return _noted(spark, rows)


@query(ORACLE_SQL["sparse_topk"])
def sparse_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As sparse_topk, through the block-max index of all documents."""
    blocks = materialise(inverted.build(_postings(_points(spark, sf_dir))), "blocks")
    return _ranks(inverted.search(blocks, _asked(spark, sf_dir), TOP_N, pattern=text.ORACLE_TOKEN))


@query()
def dense_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense top-n through the quantised index with an eighth of its cells left out; not exact (its recall is tested)."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("source_file"), F.col("embedding").alias("dense"))
    model = quantised.fit(points, 16)
    codes = materialise(quantised.encoded(points, model), "codes")
    return _ranks(quantised.Index(codes, model).search(_asked(spark, sf_dir), TOP_N, 14)).withColumn("id", F.col("id").cast("bigint"))
