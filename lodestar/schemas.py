"""Schemas of the engine's tables."""

from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source_file", T.StringType(), False),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("total_chunks", T.IntegerType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("dense", T.ArrayType(T.FloatType())),
])

#: The distinct terms of a point, joined by spaces, their counts, and how many words it has.
POSTINGS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source_file", T.StringType(), False),
    T.StructField("length", T.IntegerType(), False),
    T.StructField("terms", T.StringType(), False),
    T.StructField("counts", T.ArrayType(T.IntegerType()), False),
])

#: A point's cell and code in the approximate index of vectors.
CODES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source_file", T.StringType(), False),
    T.StructField("cell", T.IntegerType(), False),
    T.StructField("code", T.BinaryType(), False),
    T.StructField("dense", T.ArrayType(T.FloatType())),
])

FILES = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_hash", T.StringType()),
    T.StructField("file_mtime", T.DoubleType()),
    T.StructField("chunk_count", T.IntegerType()),
    T.StructField("last_indexed_at", T.DoubleType()),
])

COLLECTIONS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("folder_path", T.StringType(), False),
    T.StructField("ignore_patterns", T.ArrayType(T.StringType())),
    T.StructField("ignore_extensions", T.ArrayType(T.StringType())),
])

TASKS = T.StructType([
    T.StructField("collection", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("in_progress", T.BooleanType(), False),
])

#: A stored task: who holds it and until when, the error it ended with, and when it was accepted.
LEASES = T.StructType([
    T.StructField("task", T.StringType(), False),
    T.StructField("collection", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("worker", T.StringType()),
    T.StructField("until", T.DoubleType(), False),
    T.StructField("error", T.StringType()),
    T.StructField("at", T.DoubleType(), False),
])

LISTING = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("rel_path", T.StringType(), False),
    T.StructField("file_mtime", T.DoubleType(), False),
    T.StructField("size", T.LongType(), False),
])
