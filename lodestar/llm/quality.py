"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text come from numpy passes over the byte buffer of an Arrow
batch. Trees are grown level by level on binned statistics, and kept as flat
arrays (feature, bin threshold, leaf value) that numpy walks for a whole batch
at once.

Defined cases: a null text counts as empty; an empty text has all statistics 0
and gets the score the trees give that; without any training row of both
classes the score is the share of label 1 (0.5 if there is none). Repeated
rows each get a score; a text is read whole, whatever its length; an empty table gives an empty one; other columns
pass through, but for one that has the name of the result, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import labels as L
from lodestar.llm.textops import U, Words, mix, shingles, slices, string_buffers

#: Bound of the labelled rows a model is fitted on.
TRAINING_ROWS = 20_000

_GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r", "newline": b"\n",
    "stop": b".", "comma": b",", "mark": b"!?", "colon": b";:", "quote": b"\"'`", "bracket": b"()[]{}<>", "bar": b"|", "hash": b"#", "dollar": b"$",
    "percent": b"%", "amp": b"&", "star": b"*", "other": b"=_~^@\\/+-",
}
_CLASS = np.full(256, len(_GROUPS), dtype=np.uint8)
for _k, _chars in enumerate(_GROUPS.values()):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = len(_GROUPS) + 1
FEATURES = ["log_bytes", "log_words", *_GROUPS, "control", "non_ascii", "word_bytes", "word_spread", "long_words", "tiny_words", "distinct_words", "top_word", "distinct_shingles", "log_lines", "line_bytes", "repeated_lines", "lines_ended", "capital_words"]


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct values, and occurrences of the commonest."""
    key = (doc.astype(U) << U(48)) | (value >> U(16))
    key.sort()
    if not len(key):
        return np.zeros(n), np.zeros(n)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.diff(np.append(at, len(key)))
    of = (key[at] >> U(48)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, run)
    return np.bincount(of, minlength=n).astype(float), top


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    words = Words(raw, offsets)
    n, cuts = len(offsets) - 1, words.cuts
    b = raw[int(offsets[0]) : int(offsets[-1])]
    size = np.diff(cuts).astype(float)
    doc_b = np.repeat(np.arange(n), np.diff(cuts))
    some = np.maximum(size, 1)
    share = np.bincount(doc_b * 20 + _CLASS[b], minlength=n * 20).reshape(n, 20) / some[:, None]
    count = np.diff(words.first).astype(float)
    each = np.maximum(count, 1)
    doc = words.doc()
    length = (words.end - words.start).astype(float)
    total = lambda x, by=doc: np.bincount(by, weights=x, minlength=n)
    mean = total(length) / each
    spread = np.sqrt(np.maximum(total(length**2) / each - mean**2, 0))
    different, top = _distinct(doc, words.hash, n)
    where, value, _ = shingles(words)
    unlike, _ = _distinct(where, value, n)
    n_shingles = np.maximum(np.bincount(where, minlength=n), 1)
    # A line's value is the sum of its word hashes, each mixed with its place in the line.
    newline = np.flatnonzero(b == 10)
    line_start = np.unique(np.concatenate([cuts[:-1][size > 0], newline + 1]))
    line_start = line_start[line_start < len(b)]
    line_doc = doc_b[line_start] if len(line_start) else np.empty(0, np.int64)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    if len(line_start):
        of_word = np.searchsorted(line_start, words.start, side="right") - 1
        place = np.arange(len(words.start)) - np.searchsorted(of_word, of_word)
        content = np.zeros(len(line_start), dtype=U)
        np.add.at(content, of_word, mix(words.hash + mix(place.astype(U))))
        line_end = np.append(line_start[1:], len(b)) - 1
        line_end = np.minimum(line_end, cuts[line_doc + 1] - 1)
        last = line_end - (b[line_end] == 10)  # before its start, if the line is empty
        ended = np.bincount(line_doc, weights=np.isin(b[np.maximum(last, 0)], list(b".!?")) & (last >= line_start), minlength=n)
        unlike_lines, _ = _distinct(line_doc, mix(content), n)
    else:
        ended = unlike_lines = np.zeros(n)
    first_byte = b[words.start] if len(words.start) else np.empty(0, np.uint8)
    capital = total(((first_byte >= 65) & (first_byte <= 90)).astype(float))
    some_lines = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(count), share, mean, spread, total((length >= 12).astype(float)) / each, total((length <= 1).astype(float)) / each, different / each, top / each,
        unlike / n_shingles, np.log1p(lines), size / some_lines, (lines - unlike_lines) / some_lines, ended / some_lines, capital / each,
    ]).astype(np.float32)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of the array."""
    raw, offsets = string_buffers(column)
    rows = [_statistics(raw, offsets[a : e + 1]) for a, e in slices(offsets)]
    return np.concatenate(rows) if rows else np.empty((0, len(FEATURES)), np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth: arrays [tree, node] and [tree, leaf]."""

    edges: list[np.ndarray]
    feature: np.ndarray
    below: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        n, (trees, nodes) = len(x), self.feature.shape
        out = np.full(n, self.base)
        if n and trees:
            binned, rows = self.bins(x), np.arange(n)
            for t in range(trees):
                at = np.zeros(n, dtype=np.int64)
                while at[0] < nodes:  # all rows stand on one level
                    at = 2 * at + 1 + (binned[rows, self.feature[t, at]] > self.below[t, at])
                out += self.leaf[t, at - nodes]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 8.0) -> Trees:
    """Newton boosting of the logistic loss on histograms of binned statistics."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    nodes = 2**depth - 1
    model = Trees([np.empty(0, np.float32)] * x.shape[1], np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.int64), np.zeros((0, nodes + 1)), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], quantiles)).astype(np.float32) for k in range(x.shape[1])]
    binned = model.bins(x).astype(np.int64)
    n, f = binned.shape
    flat = binned + np.arange(f) * bins
    margin = np.full(n, model.base)
    kept = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, below = np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((at - first) * (f * bins))[:, None] + flat
            g, h = (np.bincount(key.ravel(), weights=np.repeat(v, f), minlength=width * f * bins).reshape(width, f, bins) for v in (grad, hess))
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(split, best // bins, 0)
            below[first : first + width] = np.where(split, best % bins, 255)
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > below[at])
        g, h = (np.bincount(at - nodes, weights=v, minlength=nodes + 1) for v in (grad, hess))
        leaf = -rate * g / (h + l2)
        margin += leaf[at - nodes]
        kept.append((feature, below, leaf))
    model.feature, model.below, model.leaf = (np.stack(v) for v in zip(*kept, strict=True))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAINING_ROWS) -> Trees:
    """Fit on at most ``limit`` labelled rows; only their statistics reach the driver."""
    rows = L.training_rows(docs, labels, label, limit)

    @F.arrow_udf("array<float>")
    def measured(text: pa.Array) -> pa.Array:
        x = statistics(text)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))

    got = rows.select("doc_id", "y", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"), measured("text").alias("x")).toArrow()
    order = np.lexsort((got["m"].to_numpy().astype(str), got["doc_id"].to_numpy()))
    x = got["x"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(got) else np.empty((0, len(FEATURES)), np.float32)
    return fit(x[order], got["y"].to_numpy()[order])


def score(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's probability of label 1."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(column)))

    return docs.withColumn(name, scored(F.col(text)))
