"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import labels as L
from lodestar.llm import ann, chat, codes, decontaminate, exact, licenses, mixing, neardup, quality, runs, secrets, tokens, toxicity
from lodestar.llm.session import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), least_words=1)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, marks))
    return scored.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("score_hits").alias("hits"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.neighbours(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.sha2(secrets.joined(F.filter("spans", lambda s: s["place"] < secrets.BASE)), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base, secrets.joined(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, marks))
    return scored.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = runs.with_runs(docs, repeat=F.when(h % 10 == 0, F.floor(h / 10))).select("doc_id", "found.*")
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), runs.best(F.col("runs")).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_neighbours": op7_neighbours,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOG_FACTORIALS = ", ".join(repr(math.lgamma(k + 1)) for k in range(mixing.TERMS))
_OP4_SQL = f"""
WITH counted AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
     rated AS (SELECT s, (sum(n) OVER ())::DOUBLE * (1.0::DOUBLE / (count(*) OVER ())::DOUBLE) / n AS rate FROM counted),
     drawn AS (SELECT s, rate, ceil(rate / {mixing.MEAN_OF_DRAW!r}::DOUBLE)::INT AS draws FROM rated),
     terms AS (SELECT s, draws, list_transform([{_LOG_FACTORIALS}]::DOUBLE[], lambda g, k: exp((k - 1)::DOUBLE * ln(rate / draws) - rate / draws - g)) AS p FROM drawn),
     tables AS (SELECT s, draws, list_transform(range(1, {mixing.TERMS + 1}), lambda n: list_reduce(list_prepend(0.0::DOUBLE, p[1:n]), lambda t, x: t + x)) AS cdf FROM terms),
     counts AS (SELECT d.* EXCLUDE (number), list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cdf, lambda c: c <= (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || number || ':' || j::VARCHAR), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)))) AS copies
                FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1 AS number FROM documents) d JOIN tables t ON d.source IS NOT DISTINCT FROM t.s)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, copies::BIGINT))::INT AS copy FROM counts
"""

_ENTRIES = licenses.Index()
_VALUES = ", ".join(f"({e}, '{w}', {k})" for e, entry in enumerate(_ENTRIES.entries) for w, k in entry.words)
_NEEDS = ", ".join(f"({e}, {entry.need}, '{entry.label}', {-1 if entry.key is None else entry.key})" for e, entry in enumerate(_ENTRIES.entries))
_OP2_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') AS w FROM documents),
     words AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
     postings(e, word, k) AS (VALUES {_VALUES}),
     entries(e, need, label, key) AS (VALUES {_NEEDS}),
     agreed AS (SELECT r, e, i - k AS word FROM words JOIN postings USING (word) GROUP BY ALL HAVING count(*) >= any_value((SELECT need FROM entries x WHERE x.e = postings.e))),
     found AS (SELECT r, e, word, label FROM agreed a JOIN entries USING (e)
               WHERE e < {_ENTRIES.base} OR (e >= {_ENTRIES.notices} AND EXISTS (SELECT 1 FROM agreed b WHERE b.r = a.r AND b.e = key))),
     summed AS (SELECT r, count(*) FILTER (e < {_ENTRIES.base}) AS n_base, min(word) FILTER (e < {_ENTRIES.base}) AS first_word, max(word) FILTER (e < {_ENTRIES.base}) AS last_word,
                       string_agg(DISTINCT label, ',' ORDER BY label) FILTER (e < {_ENTRIES.base}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(*) AS n FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, 1 - pow(0.5::DOUBLE, coalesce(n, 0)::DOUBLE) AS score
FROM docs LEFT JOIN summed USING (r)
"""

# DuckDB's expressions have no look behind: there the character before is part of the match, and its length is taken off.
_BEFORE = "(?<![A-Za-z0-9_-])"
_RULES = "\n     UNION ALL ".join(
    f"SELECT r, {k} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}', 0) AS whole, regexp_extract_all(t, '{p}', {rule.group}) AS counted, {lead} AS lead FROM docs"
    for k, rule in enumerate(secrets.RULES)
    for p in [rule.pattern.replace("'", "''").replace(_BEFORE, "(^|[^A-Za-z0-9_-])")]
    for lead in [f"regexp_extract_all(t, '{p}', 1)" if _BEFORE in rule.pattern else "CAST([] AS VARCHAR[])"]
)
_OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     cut AS ({_RULES}),
     matched AS (SELECT r, place, kind, least, i, length(pieces[i]) AS gap, length(whole[i]) AS size, length(counted[i]) AS counted, coalesce(length(lead[i]), 0) AS lead
                 FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM cut WHERE len(whole) > 0)),
     spans AS (SELECT r, place, kind, size, least, counted, lead, sum(gap) OVER w + coalesce(sum(size) OVER before, 0) AS pos FROM matched
               WINDOW w AS (PARTITION BY r, place ORDER BY i ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY r, place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     kept AS (SELECT r, place, kind, pos + lead AS pos, kind || ':' || (pos + lead)::BIGINT::VARCHAR || ':' || (pos + size)::BIGINT::VARCHAR AS span FROM spans WHERE counted >= least),
     summed AS (SELECT r, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
                       string_agg(span, ',' ORDER BY pos, place) FILTER (place < {secrets.BASE}) AS base, string_agg(span, ',' ORDER BY pos, place) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (r)
"""

_OP5_SQL = f"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER w - 1 AS place, role, text, coalesce(role, '\\0') || chr(1) || coalesce(text, '\\0') AS content
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
     convs AS (SELECT c, count(*) AS n, list(content ORDER BY place) AS content FROM turns GROUP BY c),
     firsts AS (SELECT min(c) AS c, n, content FROM convs GROUP BY n, content),
     starts AS (SELECT DISTINCT content[1:k] AS content FROM (SELECT content, n, unnest(range(1, n)) AS k FROM firsts)),
     kept AS (SELECT c, n FROM firsts WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.content = firsts.content))
SELECT k.c AS conv_id, t.place // {chat.RUN} AS part, k.n AS turns, count(*) AS n,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.place) AS text
FROM kept k JOIN turns t ON t.c IS NOT DISTINCT FROM k.c GROUP BY k.c, k.n, t.place // {chat.RUN}
"""

_FIRST = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     parts AS MATERIALIZED (SELECT r, j, v[(j * len(v)) // {codes.PARTS} + 1:((j + 1) * len(v)) // {codes.PARTS}] AS v FROM (SELECT r, v, unnest(range(0, {codes.PARTS})) AS j FROM kept)),
     book0 AS (SELECT j, r - 1 AS e, v AS w FROM parts WHERE r <= {codes.ENTRIES})"""
_ROUND = """,
     near{k} AS MATERIALIZED (SELECT r, j, min({{'d': list_sum(list_transform(v, lambda x, c: (x - w[c]) * (x - w[c]))), 'e': e}}) AS best FROM parts JOIN book{k} USING (j) GROUP BY r, j)"""
_MOVED = """,
     means{k} AS (SELECT j, best.e AS e, c, sum(v[c]) AS s, count(*) AS n FROM near{k} JOIN parts USING (r, j), range(1, (SELECT max(len(v)) FROM parts) + 1) t(c) GROUP BY j, best.e, c),
     lists{k} AS (SELECT j, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY c) AS m FROM means{k} GROUP BY j, e),
     book{l} AS MATERIALIZED (SELECT j, e, coalesce(m, w) AS w FROM book{k} LEFT JOIN lists{k} USING (j, e))"""
_OP11_SQL = f"""{_FIRST}{"".join(_ROUND.format(k=k) + _MOVED.format(k=k, l=k + 1) for k in range(codes.ROUNDS))}{_ROUND.format(k=codes.ROUNDS)},
     coded AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY j) AS code, sum(best.d)::BIGINT AS error FROM near{codes.ROUNDS} GROUP BY r),
     hashed AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM book{codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), hashed
"""

_OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _OP11_SQL,
    "op12_exact_dedup": _OP12_SQL,
    "op5_chat": _OP5_SQL,
    "op2_licenses": _OP2_SQL,
    "op9_secrets": _OP9_SQL,
    "op4_mixing": _OP4_SQL,
}
