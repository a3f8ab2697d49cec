"""Embedders: text to dense vectors. Each has ``name``, ``dim`` and ``column(text)``."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.batches import parts

BATCH = 64
#: Words and trigrams whose hashes a worker keeps, about 0.2 kB each.
WORDS, TRIGRAMS = 20_000, 50_000


@lru_cache(maxsize=TRIGRAMS)
def _hash(part: str) -> bytes:
    """The little-endian bytes of a 64-bit hash."""
    return hashlib.blake2b(part.encode(), digest_size=8).digest()


@lru_cache(maxsize=WORDS)
def _features(word: str) -> bytes:
    """Hashes of a word and its letter trigrams, 8 bytes each. Words are often new ones, their trigrams seldom."""
    framed = f"#{word}#"
    return b"".join([hashlib.blake2b(word.encode(), digest_size=8).digest(), *[_hash(framed[k : k + 3]) for k in range(len(word))]])


class HashingEmbedder:
    """Deterministic feature hashing of words and letter trigrams; needs no model.

    It is a stand-in for a neural model and makes no claim to its quality.
    """

    def __init__(self, dim: int = 128):
        self.dim, self.name = dim, f"hashing-{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            if words := (text or "").lower().split():
                h = np.frombuffer(b"".join(map(_features, words)), "<u8")
                row += np.bincount((h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), self.dim).astype(np.float32)
            if (size := np.sqrt((row * row).sum())) > 0:
                row /= size
        return out

    def column(self, text: Column, is_query: bool = False) -> Column:
        return _udf(self.encode)(text)


class OnnxEmbedder:
    """A local ONNX model with its ``tokenizer.json``, one session for each worker.

    Mean-pooled last hidden state, unit length. Sessions take one thread each, as
    parallelism comes from Spark's tasks. ``prefixes`` are put before documents
    and queries, for models that expect them.
    """

    def __init__(self, folder: str, dim: int, model: str = "model.onnx", prefixes: tuple[str, str] = ("", "")):
        self.folder, self.dim, self.model, self.prefixes = folder, dim, model, prefixes
        self.name = os.path.basename(os.path.abspath(folder))

    def column(self, text: Column, is_query: bool = False) -> Column:
        folder, model, prefix = self.folder, self.model, self.prefixes[int(is_query)]

        def encode(texts: list[str]) -> np.ndarray:
            session, tokenizer = _session(folder, model)
            got = []
            for a in range(0, len(texts), BATCH):
                coded = tokenizer.encode_batch([prefix + (t or "") for t in texts[a : a + BATCH]])
                mask = np.array([c.attention_mask for c in coded])
                hidden = session.run(None, _feed(session, coded))[0]
                pooled = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
                got.append(pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12))
            return np.concatenate(got) if got else np.empty((0, 0), np.float32)

        return _udf(encode)(text)


class OnnxReranker:
    """A local ONNX cross-encoder with its ``tokenizer.json``: the first logit of (query, passage).

    An instance is a scorer of ``retrieval.rerank``; candidates are scored in batches where
    they are, with one session for each worker.
    """

    def __init__(self, folder: str, model: str = "model.onnx", most_tokens: int = 512):
        self.folder, self.model, self.most_tokens = folder, model, most_tokens

    def __call__(self, query: Column, passage: Column, pattern: str | None = None) -> Column:
        folder, model, most = self.folder, self.model, self.most_tokens

        @F.arrow_udf(T.DoubleType())
        def scored(q: pa.Array, p: pa.Array) -> pa.Array:
            session, tokenizer = _session(folder, model)
            tokenizer.enable_truncation(most)
            pairs = [(a or "", b or "") for a, b in zip(q.to_pylist(), p.to_pylist(), strict=True)]
            got = [np.empty(0)]
            for a in range(0, len(pairs), BATCH):
                got.append(session.run(None, _feed(session, tokenizer.encode_batch(pairs[a : a + BATCH])))[0].reshape(len(pairs[a : a + BATCH]), -1)[:, 0])
            return pa.array(np.concatenate(got).astype(np.float64))

        return scored(query, passage)


def _feed(session, coded: list) -> dict[str, np.ndarray]:
    ids, mask, kinds = (np.array([getattr(c, name) for c in coded], dtype=np.int64) for name in ("ids", "attention_mask", "type_ids"))
    wanted = {i.name for i in session.get_inputs()}
    return {k: v for k, v in {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds}.items() if k in wanted}


_sessions: dict = {}


def _session(folder: str, model: str):
    if (key := (folder, model)) not in _sessions:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        tokenizer.enable_padding()
        _sessions[key] = onnxruntime.InferenceSession(os.path.join(folder, model), options), tokenizer
    return _sessions[key]


def _udf(encode):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            vectors = [encode(part.to_pylist()).astype(np.float32) for part in parts(batch)]
            vectors = np.concatenate(vectors) if vectors else np.empty((0, 0), np.float32)
            width = vectors.shape[1] if vectors.ndim == 2 else 0
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width), pa.array(vectors.ravel()))

    return embedded
