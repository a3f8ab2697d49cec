"""Periodic runs of words by the runs theorem, and texts without their repetitions.

A run is a stretch of words with smallest period q (words q apart are the same) that no
neighbouring word extends. By the runs theorem each run holds the longest Lyndon word of one of
its places, under the order of words or the reversed one, as a root of length q.

1. Words get numbers by an exact dictionary; a slice of texts is one array of numbers.
2. Inverse suffix array by prefix doubling, under both orders; texts never mix, and only suffixes
   that are still tied are sorted again.
3. The longest Lyndon word at a place ends before the next smaller value of that array.
4. A run of ``exponent`` periods (at least 4) holds three equal roots one after the other, so places where that
   isn't so are passed over, which loses nothing.
5. The roots left are extended: to the right by the smallest of the LCPs between both suffixes, from
   a sparse table; to the left likewise on the reversed words. Only texts with such roots need these.

A text is taken whole by one task, in slices of about 1 MB of texts; a longer text is a slice of its own
and takes about 40 bytes of memory for each byte (measured at 6.6 MB: 31 without repetitions, 38 with them). No text leaves its row, nothing is shuffled.

Defined cases: a null or empty text has no words, no runs and the empty collapsed text; texts are
equal to themselves only, so repeated rows each get the same result; an empty table gives an empty one; an
input column of the result's name is replaced, other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.session import bounded
from lodestar.llm.textops import slices, string_buffers

LEAST_WORDS, EXPONENT = 6, 4
#: Places looked at one after the other before the table of minima is asked.
NEAR = 8

_RUN = T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
FOUND = T.StructType().add("n_words", T.LongType()).add("runs", T.ArrayType(_RUN)).add("collapsed", T.StringType())
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def numbered(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, first byte, length) of each word of consecutive texts, and per text the range of its words."""
    base = int(offsets[0])
    b, cuts = raw[base : int(offsets[-1])], offsets - base
    inside = _IS_WORD[b]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(b))]
    begin[inner] |= inside[inner]
    stop[inner - 1] |= inside[inner - 1]
    start = np.flatnonzero(begin)
    size = np.flatnonzero(stop) + 1 - start
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size, out=ends[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(b[inside])])
    number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return number, start, size, np.searchsorted(start, cuts)


def inverse_suffixes(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rank of each suffix among all; those of later texts come before those of earlier ones.

    A suffix ends with its text, and an end is smaller than any word.
    """
    n, texts = len(number), len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(first))
    last = np.repeat(first[1:], np.diff(first))
    key = (texts - 1 - text) * (int(number.max(initial=0)) + 1) + number
    rank = np.empty(n, dtype=np.int64)
    active, old = np.arange(n), np.zeros(n, dtype=np.int64)
    k = 0
    while len(active):
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], old[order]
        at = np.arange(len(active))
        new = np.empty(len(active), dtype=bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        outer = np.empty(len(active), dtype=bool)
        outer[0], outer[1:] = True, old[1:] != old[:-1]
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[active] = old + start - np.flatnonzero(outer)[np.cumsum(outer) - 1]
        alone = new.copy()
        alone[:-1] &= new[1:]
        active = active[~alone]
        k = k * 2 or 1
        old = rank[active]
        ahead = active + k
        key = old * (n + 1) + np.where(ahead < last[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
    return rank


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the smallest of each 2**k values from a place on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        below, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(below[:-half], below[half:]))
    return table


def smallest(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the values from lo to hi, hi not included and greater than lo."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=np.int64)
    for k in np.unique(level).tolist():
        on = level == k
        out[on] = np.minimum(table[k][lo[on]], table[k][hi[on] - (1 << k)])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the next smaller value, or the number of values."""
    n = len(values)
    padded = np.append(values, -1).astype(np.int32 if n < 2**31 else np.int64)
    out = np.empty(n, dtype=np.int64)
    open_ = np.arange(n)
    for t in range(1, NEAR + 1):
        ahead = np.minimum(open_ + t, n)
        got = padded[ahead] < padded[open_]
        out[open_[got]] = ahead[got]
        open_ = open_[~got]
    if not len(open_):
        return out
    table = minima(padded)
    at, own = open_ + NEAR + 1, padded[open_]
    top = np.zeros(len(open_), dtype=np.int64)
    up = np.arange(len(open_))
    for k in range(len(table)):  # longer and longer steps while nothing that is stepped over is smaller
        up = up[at[up] + (1 << k) <= n + 1]
        up = up[table[k][at[up]] >= own[up]]
        if not len(up):
            break
        at[up] += 1 << k
        top[up] = k + 1
    for k in range(min(int(top.max(initial=0)), len(table) - 1), -1, -1):
        down = np.flatnonzero((top >= k) & (at + (1 << k) <= n + 1))
        down = down[table[k][at[down]] >= own[down]]
        at[down] += 1 << k
    out[open_] = at
    return out


def common_prefixes(number: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """LCP of each suffix, in the order of ranks, with the one before; 0 between texts.

    A common prefix is compared only where the words before both differ; elsewhere it is one
    shorter than at the place before.
    """
    n = len(number)
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank] = np.arange(n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][text]
    before = np.full(n, -1, dtype=np.int64)
    before[suffix[1:]] = suffix[:-1]
    before[(before >= 0) & (text[before] != text)] = -1
    here = np.arange(n)
    follows = (before > 0) & (here > 0)
    follows[follows] &= (number[here[follows] - 1] == number[before[follows] - 1]) & (text[here[follows] - 1] == text[here[follows]]) & (text[before[follows] - 1] == text[before[follows]])
    place = np.flatnonzero(~follows)
    length = np.zeros(len(place), dtype=np.int64)
    open_, wide = np.flatnonzero(before[place] >= 0), 4
    while len(open_):
        a, b = place[open_] + length[open_], before[place[open_]] + length[open_]
        step = np.arange(wide)
        room = np.minimum(last[place[open_]] - a, last[place[open_]] - b)
        same = (number[np.minimum(a[:, None] + step, n - 1)] == number[np.minimum(b[:, None] + step, n - 1)]) & (step < room[:, None])
        got = np.where(same.all(1), wide, np.argmin(same, axis=1))
        length[open_] += got
        open_ = open_[got == wide]
        wide = min(4 * wide, max(4, (1 << 16) // max(1, len(open_))))
    of = np.zeros(n, dtype=np.int64)
    of[place] = np.arange(len(place))
    of = np.maximum.accumulate(of)
    common = length[of] - (here - place[of])
    return common[suffix]


class Extensions:
    """Lengths that suffixes of one array of words have in common."""

    def __init__(self, number: np.ndarray, rank: np.ndarray, first: np.ndarray):
        self.rank, self.table = rank, minima(common_prefixes(number, rank, first))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the suffixes at a and at b, which differ and are of one text."""
        x, y = self.rank[a], self.rank[b]
        return smallest(self.table, np.minimum(x, y) + 1, np.maximum(x, y) + 1)


def roots(number: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of Lyndon words that are followed by two copies of themselves, by a necessary sign:
    their first and last words recur, and the next longest Lyndon word is as long."""
    n = len(number)
    period = next_smaller(rank) - np.arange(n)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + 3 * period <= last)
    q = period[at]
    on = (period[at + q] == q) & (number[at] == number[at + q]) & (number[at] == number[at + 2 * q])
    at, q = at[on], q[on]
    on = (number[at + q - 1] == number[at + 2 * q - 1]) & (number[at + q - 1] == number[at + 3 * q - 1])
    return at[on], q[on]


def runs(number: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of ``exponent`` periods and ``least`` words at least,
    by text, start and period; starts count from the text's first word."""
    if exponent < 4:
        raise ValueError("an exponent of 4 at least is needed")
    none = np.empty((0, 4), dtype=np.int64)
    if not len(number):
        return none
    rank = inverse_suffixes(number, first)
    found = [roots(number, rank, first), roots(number, inverse_suffixes(int(number.max()) - number, first), first)]
    at, q = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(at):
        return none
    # only the texts that hold roots, as an array of their own
    text = np.searchsorted(first, at, side="right") - 1
    own = np.unique(text)
    sizes = first[own + 1] - first[own]
    cut = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum(sizes, out=cut[1:])
    m = int(cut[-1])
    pos = np.repeat(first[own] - cut[:-1], sizes) + np.arange(m)
    of = np.searchsorted(own, text)
    at = at - first[text] + cut[of]
    words = number[pos]
    ranks = rank[pos] - np.repeat(len(number) - first[own + 1] - (m - cut[1:]), sizes)
    behind, back = words[::-1].copy(), m - cut[::-1]
    right = Extensions(words, ranks, cut).common(at, at + q)
    left = np.zeros(len(at), dtype=np.int64)
    inner = np.flatnonzero(at > cut[of])
    if len(inner):
        left[inner] = Extensions(behind, inverse_suffixes(behind, back), back).common(m - at[inner], m - at[inner] - q[inner])
    length = left + q + right
    enough = length >= np.maximum(least, exponent * q)
    rows = np.column_stack([own[of], at - left - cut[of], length, q])[enough]
    rows = np.unique(rows, axis=0)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def repeated(first: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The word that stands at each place when texts of n words repeat, from word a = g mod n on, with
    period 1 + (n - a) div (3 + g mod 8); texts of a negative g don't."""
    place = np.arange(first[-1])
    for d in np.flatnonzero((g >= 0) & (np.diff(first) > 0)).tolist():
        n = int(first[d + 1] - first[d])
        a = int(g[d]) % n
        p = 1 + (n - a) // (3 + int(g[d]) % 8)
        place[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    return place


def _scan(texts: pa.Array, g: pa.Array, least: int, exponent: int) -> pa.Array:
    raw, offsets = string_buffers(texts)
    g = g.fill_null(-1).to_numpy(zero_copy_only=False)
    counts, cuts, starts, lengths, periods, collapsed = [], [np.zeros(1, np.int64)], [], [], [], []
    for a, e in slices(offsets):
        number, start, size, first = numbered(raw, offsets[a : e + 1])
        place = repeated(first, g[a:e])
        number, start, size = number[place], start[place], size[place]
        found = runs(number, first, least, exponent)
        counts.append(np.diff(first))
        cuts.append(cuts[-1][-1] + np.cumsum(np.bincount(found[:, 0], minlength=e - a)))
        for out, column in zip((starts, lengths, periods), found.T[1:], strict=True):
            out.append(column)
        # words after a run's first period go
        gone = np.zeros(len(number) + 1, dtype=np.int64)
        begin = first[found[:, 0]] + found[:, 1]
        np.add.at(gone, begin + found[:, 3], 1)
        np.add.at(gone, begin + found[:, 2], -1)
        kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        ends = np.zeros(len(kept) + 1, dtype=np.int64)
        np.cumsum(size[kept] + 1, out=ends[1:])
        b = raw[int(offsets[a]) : int(offsets[e])]
        joined = b[np.minimum(np.repeat(start[kept] - ends[:-1], size[kept] + 1) + np.arange(ends[-1]), len(b) - 1)] if len(kept) else b[:0]
        joined[ends[1:] - 1] = 0x20
        at = ends[np.searchsorted(kept, first)]
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            collapsed.append(joined[x : max(x, y - 1)].tobytes())
    whole = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
    each = pa.StructArray.from_arrays([pa.array(whole(x)) for x in (starts, lengths, periods)], fields=list(_ARROW_RUN))
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), each)
    return pa.StructArray.from_arrays([pa.array(whole(counts)), listed, pa.array(collapsed, type=pa.binary()).cast(pa.string())], names=FOUND.names)


def with_runs(docs: DataFrame, text_col: str = "text", name: str = "found", least: int = LEAST_WORDS, exponent: int = EXPONENT, repeat: Column | None = None) -> DataFrame:
    """``docs`` with a struct ``name`` of n_words, runs (start, length, period; by start, then
    period) and collapsed, the words joined by one space but for those that a run repeats.

    Where ``repeat`` is a number, the text's words are first made to repeat by it (see ``repeated``).
    """
    bounded(docs.sparkSession)

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array, g: pa.Array) -> pa.Array:
        return _scan(texts, g, least, exponent)

    # else the optimizer would put the call into whatever reads the result, once for each use
    scanned = scanned.asNondeterministic()
    g = F.lit(None) if repeat is None else repeat
    return docs.withColumn(name, scanned(F.col(f"`{text_col}`"), g.cast("bigint")))


def best(found: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs are ordered by start and period
    none = F.lit(None).cast(_RUN)
    return F.aggregate(found, none, lambda top, x: F.when(top.isNull() | ahead(x, top), x).otherwise(top))
