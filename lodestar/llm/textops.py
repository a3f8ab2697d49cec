"""Vectorised text primitives on Arrow string buffers.

A batch of texts is one byte buffer plus offsets. Folding, word boundaries and
word hashes are computed for the whole buffer with numpy, so the cost is a few
passes over the bytes and no Python object is made per word. Word hashes are
differences of a prefix sum of ``byte * P**position`` modulo 2**64, shifted back
by the inverse power, then mixed.

Words are maximal runs of digits, ASCII letters and bytes of non-ASCII
characters, after lower-casing ASCII and Latin-1 capitals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("pow", _P), ("inv", _P_INV)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64; a bijection on 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes, one row at least, so that memory
    follows the slice and not the batch. A longer text is a slice of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end), at + 30_000)
        yield at, end
        at = end


class Words:
    """Words of consecutive texts: ``hash``, byte ``start``/``end``, and per text
    the range ``first[i]:first[i+1]``. ``folded`` is the lower-cased buffer."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        cuts = (offsets - base).astype(np.int64)
        b = _FOLD[raw[base : int(offsets[-1])]]
        if len(b) > 1:
            capital = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
            b[1:][capital] += 0x20
        n = len(b)
        inside = _IS_WORD[b]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        inner = cuts[(cuts > 0) & (cuts < n)]
        begin[inner] |= inside[inner]
        stop[inner - 1] |= inside[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((b.astype(U) + U(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, cuts)
        self.folded = b
        self.cuts = cuts

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def batches_of_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = string_buffers(column)
    for at, end in slices(offsets):
        yield at, end, Words(raw, offsets[at : end + 1])


def shingles(words: Words, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, first word) of every k-word shingle, in order.

    A text of 1 to k-1 words has a single shingle of all its words; a text
    without words has none.
    """
    h, first = words.hash, words.first
    n = len(h)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    if n >= k:
        acc = np.zeros(n - k + 1, dtype=U)
        for j in range(k):
            acc = acc * U(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        where, value = doc[at], mix(acc[at])
    else:
        at = where = np.empty(0, np.int64)
        value = np.empty(0, U)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for d in short:
            x = 0
            for y in h[first[d] : first[d + 1]].tolist():
                x = (x * 0xD6E8FEB86659FD93 + y) & 0xFFFFFFFFFFFFFFFF
            extra.append(x)
        where = np.concatenate([where, short])
        value = np.concatenate([value, mix(np.array(extra, dtype=U))])
        at = np.concatenate([at, first[short]])
        order = np.argsort(where, kind="stable")
        where, value, at = where[order], value[order], at[order]
    return where, value, at


def weighted_shingles(words: Words, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 48-bit shingle id, multiplicity), sorted by text and id."""
    where, value, _ = shingles(words, k)
    key = (where.astype(U) << U(48)) | (value >> U(16))
    key.sort()
    if not len(key):
        return np.empty(0, np.int64), key, np.empty(0, np.float64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(new, len(key))).astype(np.float64)
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U(0xFFFFFFFFFFFF), counts


def sequence_hash(words: Words) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence, as an (n, 2) array."""
    count = np.diff(words.first)
    doc = words.doc()
    place = (np.arange(len(words.hash)) - np.repeat(words.first[:-1], count)).astype(U)
    out = np.empty((len(count), 2), dtype=U)
    for j, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        term = mix(words.hash ^ mix(place * U(2) + U(salt)))
        total = np.zeros(len(term) + 1, dtype=U)
        np.cumsum(term, out=total[1:])
        out[:, j] = mix(total[words.first[1:]] - total[words.first[:-1]] + count.astype(U))
    return out
