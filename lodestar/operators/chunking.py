"""From documents to rows of blocks and chunks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.batches import each, parts
from lodestar.functions.text import ORACLE_TOKEN, is_blank, suffix, tokens
from lodestar.operators import markdown

CHUNK_TOKENS, CHUNK_OVERLAP = 256, 32
#: What words consist of, as a class of a regular expression.
WORD_CHARS = r"\p{L}\p{N}_"
BLOCK = T.ArrayType(T.StructType().add("kind", T.StringType()).add("text", T.StringType()))


@F.arrow_udf(BLOCK)
def _blocks(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    return each(text, lambda t: [{"kind": b.kind, "text": b.text} for b in markdown.blocks(t)], kind)


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each block: ``docs`` without its text, block_index from 0, kind, text."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode_outer(_blocks(text)).alias("block_index", "b")).filter("b IS NOT NULL").select(*rest, "block_index", "b.*")


def line_kinds(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line: ``docs`` without its text, line from 0, the kind of block it would begin."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def kinds(column: pa.Array) -> pa.Array:
        return each(column, lambda t: [markdown.line_kind(line.strip()) for line in (t or "").split("\n")], pa.list_(pa.string()))

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(kinds(text)).alias("line", "kind"))


def _numbered(docs: DataFrame, pieces, rest: list[str]) -> DataFrame:
    """Rows of chunks with chunk_index from 0 and total_chunks."""
    listed = docs.select(*rest, pieces.alias("_c")).withColumn("total_chunks", F.size("_c"))
    return listed.select(*rest, "total_chunks", F.posexplode_outer("_c").alias("chunk_index", "text")).filter("chunk_index IS NOT NULL")


def markdown_chunks(docs: DataFrame, text: str = "text", size: int = markdown.BLOCKS_PER_CHUNK, overlap: int = markdown.OVERLAP) -> DataFrame:
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add("_pieces", T.ArrayType(T.StringType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks are handed on part by part, so a worker never holds those of a whole batch."""
        for batch in batches:
            at = 0
            for part in parts(batch.column(len(rest))):
                pieces = pa.array([markdown.chunks(t, size, overlap) for t in part.to_pylist()], type=pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns[: len(rest)], pieces], schema.names)
                at += len(part)

    return _numbered(docs.select(*rest, text).mapInArrow(cut, schema), F.col("_pieces"), rest)


def window_starts(n, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP):
    """Array of the windows' first tokens, for a column with the number of tokens.

    A window begins every ``size - overlap`` tokens, the last is the first that reaches the end.
    """
    step = size - overlap
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - overlap - 1, F.lit(step)))


def token_windows(docs: DataFrame, text: str = "text", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, pattern: str = ORACLE_TOKEN) -> DataFrame:
    """Windows of regex tokens joined by a space, without leaving the JVM."""
    rest = [c for c in docs.columns if c != text]
    split = docs.select(*rest, tokens(F.col(text), pattern).alias("_t"))
    pieces = F.transform(window_starts(F.size("_t"), size, overlap), lambda s: F.array_join(F.slice("_t", s + 1, F.lit(size)), " "))
    return _numbered(split, pieces, rest)


def char_windows(docs: DataFrame, tokenizer_file: str | None = None, text: str = "text", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows that are slices of the original text, at token boundaries.

    With a tokenizer file its offsets count (special tokens left out, so the last
    window reaches the end); without one, tokens are words, and the windows are found
    in the JVM. Blank windows drop.
    """
    rest = [c for c in docs.columns if c != text]
    if tokenizer_file is None:
        return _numbered(docs, _word_windows(F.col(text), size, overlap), rest)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(column: pa.Array) -> pa.Array:
        offsets = _offsets(tokenizer_file)
        return each(column, lambda t: list(_slices(t or "", offsets, size, overlap)), pa.list_(pa.string()))

    return _numbered(docs, cut(F.col(text)), rest)


def _word_windows(text: Column, size: int, overlap: int) -> Column:
    """The text is cut every ``size - overlap`` words; a window is such a piece and the first ``overlap`` words of the next.

    Words and what is between them have no character in common, so the patterns never go back.
    """
    step = size - overlap
    words = lambda n: f"(?:[^{WORD_CHARS}]*+[{WORD_CHARS}]++){{1,{n}}}+"
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    count = lambda t: F.size(F.regexp_extract_all(t, F.lit(f"[{WORD_CHARS}]+"), F.lit(0)))

    def windows(pieces: Column) -> Column:
        n = (F.size(pieces) - 1) * step + count(F.element_at(pieces, -1))
        head = lambda k: F.when(k + 1 < F.size(pieces), F.regexp_extract(F.get(pieces, k + 1), f"^{words(overlap)}", 0)).otherwise("") if overlap else F.lit("")
        cut = lambda k: F.regexp_replace(F.concat(F.get(pieces, k), head(k)), f"^[^{WORD_CHARS}]+", "")
        return let(n, lambda m: F.when(m > size, F.transform(F.sequence(F.lit(0), F.ceil((m - overlap) / step).cast("int") - 1), cut)))

    found = let(F.regexp_extract_all(text, F.lit(words(step)), F.lit(0)), lambda pieces: F.when(F.size(pieces) > 1, windows(pieces)))
    return F.when(is_blank(F.coalesce(text, F.lit(""))), F.array().cast("array<string>")).otherwise(F.coalesce(found, F.array(text)))


def _slices(text: str, offsets, size: int, overlap: int) -> Iterator[str]:
    if not text.strip():
        return
    spans = offsets(text)
    if len(spans) <= size:
        yield text
        return
    for start in range(0, len(spans) - overlap, size - overlap):
        piece = text[spans[start][0] : spans[min(start + size, len(spans)) - 1][1]]
        if piece.strip():
            yield piece


_tokenizers: dict = {}


def _offsets(path: str):
    """A function from text to (start, end) of its tokens; loaded once in each worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(os.fspath(path))
    model = _tokenizers[path]
    return lambda t: model.encode(t, add_special_tokens=False).offsets


def chunk_files(files: DataFrame, path: str = "file_path", text: str = "text", tokenizer_file: str | None = None, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``.md`` files by headings, every other suffix by token windows. Blank files have no chunk.

    ``read`` gives paths their texts; it gets each kind's paths apart, so that no file is read for both.
    """
    is_md = suffix(F.col(path)) == ".md"
    kinds = [files.filter(is_md), files.filter(~is_md)]
    marked, plain = ((read(k) if read else k).filter(~is_blank(F.coalesce(F.col(text), F.lit("")))) for k in kinds)
    return markdown_chunks(marked, text).unionByName(char_windows(plain, tokenizer_file, text))


def reconstruct(chunks: DataFrame, key: str = "source_file", index: str = "chunk_index", text: str = "text", glue: str = "\n\n", overlap: int = 0, total: str | None = None) -> DataFrame:
    """(key, n_chunks, text): the chunks of each file in order.

    With ``overlap`` they are windows of words, and each but the first loses the words it shares with the one before: what
    comes back is the text from its first word to its last. With ``total``, a column of how many chunks the file has, ``complete``
    tells whether they are all there, each once; the text of an incomplete file is null.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t"))))
    grouped = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), parts.alias("_parts"), *([F.max(total).alias("_total"), F.count_distinct(F.col(index)).alias("_own")] if total else []))
    texts = F.transform("_parts", lambda p, i: F.when(i == 0, p["t"]).otherwise(F.regexp_replace(p["t"], f"^(?:[^{WORD_CHARS}]*+[{WORD_CHARS}]++){{{overlap}}}", "")) if overlap else p["t"])
    whole = F.array_join(texts, "" if overlap else glue)
    if not total:
        return grouped.select(key, "n_chunks", whole.alias("text"))
    complete = (F.col("n_chunks") == F.col("_total")) & (F.col("_own") == F.col("_total"))
    return grouped.select(key, "n_chunks", complete.alias("complete"), F.when(complete, whole).alias("text"))
