"""Token counts by scanning flat token files for end-of-document identifiers.

A token file is a sequence of little-endian token identifiers of 2 bytes (4, if
the vocabulary needs them), documents one after the other, each closed by the
end-of-document identifier; nothing tells where they begin. Files are scanned as blocks of equal size, in parallel
and in any order:

1. Each block is one numpy comparison. It gives the documents that begin and end
   inside, and a summary: tokens, separators, tokens after the last separator.
2. A prefix scan over the summaries of a file gives, for each block, how many
   documents have ended before it and how many tokens of an unfinished one it
   continues. The scan has two levels (runs of RUN blocks, then within a run),
   so even the summaries of one huge file need no single task.
3. A block's first separator is stitched with what it continues.

``encode`` writes such files from documents, as a table of blocks in the shared
folder, with a manifest (file, ordinal, id). ``scan`` takes any table of
(file, block, data); ``read_flat`` makes one from flat binary files.

Defined cases: null and empty texts are documents of 0 tokens; a document may
span any number of blocks; tokens after a file's last separator are an
unfinished document, returned with ``ended`` false; empty files give no rows.
Identifiers in texts that look like the separator are ordinary text. Repeated
rows are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.storage import materialise
from lodestar.sources.contents import read_range, workers_can_open

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 16
WIDTH = 2
RUN = 256
#: Blocks of a flat file that are one part of a task.
RANGE = 256
# Fixed value: the vocabulary's split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def tokenizer(path: str, pattern: str = PATTERN):
    """The encoding of a vocabulary file."""
    with open(path, "rb") as f:
        return _encoding(f.read(), pattern)


def _encoding(vocabulary: bytes, pattern: str = PATTERN):
    """The encoding of a vocabulary's content, made once in each worker."""
    key = hashlib.sha256(vocabulary).digest(), pattern
    if key not in _loaded:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _loaded[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, manifest): blocks(file, block, data) and manifest(file, ordinal, id).

    A task writes one file, and keeps one block in memory besides the text at hand. The
    driver reads the vocabulary and sends it, so only its machine needs the file. A
    separator that a text could hold as a token is refused.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    most = _encoding(sent.value).max_token_value
    if separator <= most:
        raise ValueError(f"{separator} is an ordinary token")
    if max(most, separator) >= 256**width:
        raise ValueError(f"identifiers don't fit in {width} bytes")
    kind = T.StructType().add("file", T.LongType()).add("block", T.LongType()).add("data", T.BinaryType()).add("first", T.LongType()).add("ids", T.ArrayType(docs.schema[id_col].dataType))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        model = _encoding(sent.value)
        schema, number = None, f"<u{width}"
        parts: list[np.ndarray] = []
        ids: list = []
        size = block = ordinal = 0

        def full(last: bool):
            nonlocal size, block, ordinal, parts, ids
            flat = np.concatenate([*parts, np.empty(0, number)]).astype(number)
            end = len(flat) if last else len(flat) - len(flat) % block_tokens
            first, names = ordinal, ids
            ordinal, ids = ordinal + len(ids), []
            for at in range(0, end, block_tokens):
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([flat[at : min(at + block_tokens, end)].tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.array([names], pa.list_(schema))], names=kind.names)
                first, names = first + len(names), []
                block += 1
            parts, size = ([flat[end:]] if end < len(flat) else []), len(flat) - end

        for batch in batches:
            schema = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                tokens = model.encode_to_numpy(text or "", disallowed_special=())
                parts += [tokens.astype(number), np.array([separator], dtype=number)]
                size += len(tokens) + 1
                if size >= block_tokens:
                    yield from full(False)
        if size or ids:
            yield from full(True)

    both = materialise(docs.select(id_col, text_col).mapInArrow(write, kind), "tokens")
    manifest = both.select("file", "first", F.posexplode("ids").alias("k", "id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "id")
    return both.select("file", "block", "data"), manifest


def ranges(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH) -> DataFrame:
    """(file, start, end) of parts of RANGE blocks of flat binary files, of which only names and lengths are read."""
    step = width * block_tokens * RANGE
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("length")).filter("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / step)))
    return files.select("file", "length", starts.alias("k")).select("file", (F.col("k") * step).alias("start"), F.least((F.col("k") + 1) * step, F.col("length")).alias("end"))


def read_flat(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH) -> DataFrame:
    """(file, block, data) of flat binary files of any length; ``file`` is the path.

    Files are dealt to tasks in ranges of bytes, and a task holds one block. Where workers can't open the
    files, Spark's own reader does: then a file is read whole by one task and mustn't be longer than 2 GB.
    """
    step = width * block_tokens
    if workers_can_open(path):

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for at in range(start, end, step):
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at // step]), pa.array([read_range(file, at, min(step, end - at))], pa.binary())], ["file", "block", "data"])

        parts = ranges(spark, path, block_tokens, width)
        return parts.repartition("file", "start").mapInArrow(read, "file string, block long, data binary")
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / step).cast("int")), lambda k: F.substring("content", k * step + 1, F.lit(step))))
    return files.select(F.col("path").alias("file"), cut.alias("block", "data")).withColumn("block", F.col("block").cast("bigint"))


def _scanned(separator: int, width: int):
    kind = T.StructType().add("tokens", T.LongType()).add("ends", T.ArrayType(T.IntegerType()))

    @F.arrow_udf(kind)
    def scanned(data: pa.Array) -> pa.Array:
        sizes, ends = [], []
        for x in data.to_pylist():
            flat = np.frombuffer(x or b"", dtype=f"<u{width}")
            sizes.append(len(flat))
            ends.append(np.flatnonzero(flat == separator).astype(np.int32))
        cut = np.cumsum([0, *map(len, ends)]).astype(np.int32)
        values = pa.array(np.concatenate([*ends, np.empty(0, np.int32)]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), values)], ["tokens", "ends"])

    return scanned


def scan(blocks: DataFrame, separator: int = END_OF_DOCUMENT, width: int = WIDTH) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document; the separator isn't counted."""
    found = materialise(blocks.select("file", "block", _scanned(separator, width)("data").alias("s")).select("file", "block", "s.*"), "ends")
    tail = F.when(F.size("ends") > 0, F.col("tokens") - F.element_at("ends", -1) - 1).otherwise(F.col("tokens"))
    summary = found.select("file", "block", "tokens", F.size("ends").cast("bigint").alias("n"), tail.alias("tail"), (F.size("ends") > 0).alias("cuts"), F.floor(F.col("block") / RUN).alias("run"))

    # What runs of blocks hand on: separators, and tokens since the last one. A carry
    # is the sum of the tails since the last block that has a separator, its own included.
    def scanned(df: DataFrame, by: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        df = df.withColumn("since", F.coalesce(F.max(F.when(F.col("cuts"), F.col(order))).over(w), F.lit(-1)))
        df = df.withColumn("total", F.coalesce(F.sum("tail").over(w), F.lit(0)))
        # Tails of blocks before the last cut don't carry over.
        upto = F.max(F.when(F.col("cuts"), F.struct(order, "total")))
        return df.withColumn("dropped", F.coalesce(upto.over(w)["total"], F.lit(0))).withColumn("carry", F.col("total") - F.col("dropped"))

    inner = scanned(summary, ["file", "run"], "block")
    runs = summary.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max(F.col("cuts")).alias("cuts"), F.max(F.when(F.col("cuts"), F.col("block"))).alias("last"))
    ends = summary.join(runs.select("file", "run", "last"), ["file", "run"]).filter("last IS NULL OR block >= last").groupBy("file", "run").agg(F.sum("tail").alias("tail"))
    outer = scanned(runs.join(ends, ["file", "run"]), ["file"], "run").select("file", "run", F.col("before").alias("run_before"), F.col("carry").alias("run_carry"))
    starts = inner.join(outer, ["file", "run"]).select(
        "file", "block", (F.col("before") + F.col("run_before")).alias("ordinal"), (F.col("carry") + F.when(F.col("since") < 0, F.col("run_carry")).otherwise(0)).alias("carry"))
    joined = found.join(starts, ["file", "block"])
    gaps = F.transform("ends", lambda e, i: (e - F.when(i == 0, F.lit(-1)).otherwise(F.get("ends", i - 1)) - 1).cast("bigint") + F.when(i == 0, F.col("carry")).otherwise(0))
    done = joined.select("file", "ordinal", F.posexplode(gaps).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    # The highest block of a file hands on what is left after its last separator.
    left = F.when(F.size("ends") > 0, F.col("tokens") - F.element_at("ends", -1) - 1).otherwise(F.col("tokens") + F.col("carry"))
    last = joined.join(summary.groupBy("file").agg(F.max("block").alias("block")), ["file", "block"]).select("file", (F.col("ordinal") + F.size("ends")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(last.filter("n_tokens > 0"))


def counts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_tokens) of every row of ``docs``: encoded to token files, then scanned."""
    blocks, manifest = encode(docs, id_col=id_col, **options)
    got = scan(blocks, options.get("separator", END_OF_DOCUMENT), options.get("width", WIDTH))
    return manifest.join(got, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
