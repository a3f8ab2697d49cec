"""Benchmark decontamination by SimHash over item-sized windows.

An item of L words is compared with windows of L words of each document.

1. Windows. A window can only reach the threshold if so many of its five-word
   shingles belong to items of its length; other windows are passed over, which
   loses nothing. This takes one lookup for each shingle of a document.
2. A window's fingerprint is the 64-bit SimHash of its words, by differences of
   prefix sums of their signed bits.
3. Fingerprints within RADIUS bits of an item's are found through four tables
   on 16-bit blocks: if at most 19 bits differ, some block differs in at most 4,
   so probing each block with all masks of up to 4 bits finds every one.
4. Candidates are verified by the weighted Jaccard similarity (sum of minima
   over sum of maxima of counts) of five-word shingles.

A window at the threshold can differ from its item in more bits than that. Of 20,000 windows of the items of sf0.1
with their last words replaced as far as 0.8 allows none did, and 5 of 20,000 of invented items of 15 to 199 words
out of 3,000 (recall 0.9997 at 0.8, more above). With ``exact`` an item that shares enough shingles with a window is a candidate too, whatever its fingerprint,
and no match is lost.

The item tables are broadcast in blocks of about ITEMS_IN_BLOCK items and BYTES_IN_BLOCK bytes; a larger
benchmark takes further passes, one after the other, so memory doesn't grow with it. A text is
read whole, whatever its length.

Items of ``least_words`` to four words, where that is less than five, are found
as exact runs of words; their similarity is 1.

Defined cases: items of fewer than ``least_words`` words, or null ones, are not
searched; an item with a null id gives matches with a null item_id; null documents count as empty; a document
shorter than an item is compared as a whole; an item occurring several times in a document gives its best window, the
first of equals. Repeated rows each get their matches, repeated item ids each of
their texts; an empty table of documents gives an empty one, an empty one of items no match; a column of the
result's name is replaced, other columns pass through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.storage import discard, materialise
from lodestar.llm.textops import SHINGLE_WORDS, U, Words, batches_of_words, shingles, string_buffers

SIMILARITY = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
ITEMS_IN_BLOCK, BYTES_IN_BLOCK = 20_000, 32 << 20
#: Fingerprints that are probed at once.
PROBED = 64
_MASKS = np.array([0] + [sum(1 << b for b in bits) for r in range(1, RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), r)], dtype=np.int64)
MATCH = T.StructType().add("item_id", T.LongType()).add("start_word", T.IntegerType()).add("end_word", T.IntegerType()).add("similarity", T.DoubleType())


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def _blocks(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of shingles with repetitions."""
    (ea, ca), (eb, cb) = (np.unique(x, return_counts=True) for x in (a, b))
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    low = float(np.minimum(ca[ia], cb[ib]).sum())
    return low / (len(a) + len(b) - low) if len(a) + len(b) else 0.0


class ItemIndex:
    """Fingerprints and shingles of one block of items."""

    def __init__(self, ids: list[int | None], texts: list[str], threshold: float = SIMILARITY, least_words: int = SHINGLE_WORDS, exact: bool = False):
        self.exact = exact
        raw, offsets = string_buffers(pa.array(texts, type=pa.large_string()))
        words = Words(raw, offsets)
        length = np.diff(words.first)
        where, value, _ = shingles(words)
        cut = np.searchsorted(where, np.arange(len(ids) + 1))
        keep = np.flatnonzero(length >= SHINGLE_WORDS)
        self.threshold = threshold
        self.ids = [ids[k] for k in keep]
        # for each length below five, {shingle: ids of its items}
        self.short: dict[int, dict[int, list]] = {}
        for k in np.flatnonzero((length >= max(1, least_words)) & (length < SHINGLE_WORDS)).tolist():
            self.short.setdefault(int(length[k]), {}).setdefault(int(value[cut[k]]), []).append(ids[k])
        self.length = length[keep]
        self.shingles = [value[cut[k] : cut[k + 1]] for k in keep]
        sums = [_signs(words.hash[words.first[k] : words.first[k + 1]]).sum(0) for k in keep]
        self.prints = _pack(np.array(sums)) if len(keep) else np.empty(0, U)
        blocks = _blocks(self.prints)
        self.order = [np.argsort(blocks[:, j], kind="stable") for j in range(BLOCKS)]
        self.first = [np.searchsorted(blocks[self.order[j], j], np.arange(2**BLOCK_BITS + 1)) for j in range(BLOCKS)]
        # (shingle, item length), distinct, by shingle
        pairs = np.unique(np.rec.fromarrays([np.concatenate([*self.shingles, np.empty(0, U)]), np.concatenate([*(np.full(len(s), n) for s, n in zip(self.shingles, self.length, strict=True)), np.empty(0, np.int64)])]))
        self.known, self.known_length = np.asarray(pairs["f0"]), np.asarray(pairs["f1"]).astype(np.int64)
        # for each item length, (shingle, item), distinct, by shingle
        self.holders = {}
        for n in np.unique(self.length).tolist() if exact else ():
            own = np.flatnonzero(self.length == n)
            held = np.unique(np.rec.fromarrays([np.concatenate([self.shingles[k] for k in own]), np.repeat(own, [len(self.shingles[k]) for k in own])]))
            self.holders[n] = np.asarray(held["f0"]), np.asarray(held["f1"]).astype(np.int64)
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        self.bitmap[(self.known & U((1 << 22) - 1)).astype(np.int64)] = True

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all items within RADIUS bits of each fingerprint."""
        found = []
        blocks = _blocks(prints)
        for j in range(BLOCKS):
            probes = blocks[:, j, None] ^ _MASKS
            lo, hi = self.first[j][probes], self.first[j][probes + 1]
            q, m = np.nonzero(hi > lo)
            for k in range(int((hi - lo).max()) if len(q) else 0):
                on = lo[q, m] + k < hi[q, m]
                found.append(np.column_stack([q[on], self.order[j][lo[q[on], m[on]] + k]]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, item = np.unique(np.concatenate(found), axis=0).T
        close = np.bitwise_count(prints[q] ^ self.prints[item]) <= RADIUS
        return q[close], item[close]

    def sharing(self, size: int, own: np.ndarray, starts: np.ndarray, k: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of all items of ``size`` words of which ``enough`` of the ``k``
        shingles from a start are. ``own`` are the shingles of the text, ``starts`` ascend."""
        shingle, holder = self.holders[size]
        inside = np.zeros(len(own) + 1, dtype=np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.minimum(starts + k, len(own)), -1)
        place = np.flatnonzero(np.cumsum(inside[:-1]))
        a, e = np.searchsorted(shingle, own[place], side="left"), np.searchsorted(shingle, own[place], side="right")
        count = e - a
        item = holder[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())]
        place = np.repeat(place, count)
        out_start, out_item = [], []
        items, of, many = np.unique(item, return_inverse=True, return_counts=True)
        order = np.argsort(of, kind="stable")
        for i, x, n in zip(items.tolist(), (np.cumsum(many) - many).tolist(), many.tolist(), strict=True):
            if n < enough:
                continue
            at = place[order[x : x + n]]
            fit = starts[np.searchsorted(at, starts + k) - np.searchsorted(at, starts) >= enough]
            out_start.append(fit)
            out_item.append(np.full(len(fit), i))
        return np.concatenate([*out_start, np.empty(0, np.int64)]), np.concatenate([*out_item, np.empty(0, np.int64)])

    def matches(self, texts: pa.Array) -> list[list[tuple[int, int, int, float]]]:
        out: list[list] = [[] for _ in range(len(texts))]
        if not self.ids and not self.short:
            return out
        for at, _, words in batches_of_words(texts):
            self._runs(words, at, out)
            where, value, place = shingles(words)
            hit = np.flatnonzero(self.bitmap[(value & U((1 << 22) - 1)).astype(np.int64)])
            a = np.searchsorted(self.known, value[hit], side="left")
            e = np.searchsorted(self.known, value[hit], side="right")
            hit, a, e = hit[e > a], a[e > a], e[e > a]
            if not len(hit):
                continue
            docs, starts = np.unique(where[hit], return_index=True)
            for d, x, y in zip(docs.tolist(), starts.tolist(), [*starts.tolist()[1:], len(hit)], strict=True):
                position = place[hit[x:y]] - words.first[d]
                sizes = np.repeat(np.arange(y - x), e[x:y] - a[x:y])
                lengths = self.known_length[np.concatenate([np.arange(i, j) for i, j in zip(a[x:y], e[x:y], strict=True)])]
                out[at + d] += self._document(words.hash[words.first[d] : words.first[d + 1]], value[np.searchsorted(where, d) : np.searchsorted(where, d + 1)], position[sizes], lengths)
        return out

    def _runs(self, words: Words, at: int, out: list[list]) -> None:
        """Adds the first place of each short item in each text."""
        for size, items in self.short.items():
            where, value, place = shingles(words, size)
            hit = np.flatnonzero(np.isin(value, np.array(list(items), dtype=U)))
            first = np.unique(np.column_stack([where[hit].astype(U), value[hit]]), axis=0, return_index=True)[1]
            for h in hit[np.sort(first)].tolist():
                d, start = int(where[h]), int(place[h] - words.first[where[h]])
                out[at + d] += [(i, start, start + size, 1.0) for i in items[int(value[h])]]

    def _document(self, hashes: np.ndarray, own: np.ndarray, position: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int, float]]:
        n = len(hashes)
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(lengths).tolist():
            window = min(size, n)
            k = max(1, window - SHINGLE_WORDS + 1)  # shingles in a window
            seen = np.zeros(max(1, n - SHINGLE_WORDS + 1) + 1, dtype=np.int64)
            seen[position[lengths == size] + 1] = 1
            seen = np.cumsum(seen)
            enough = self.threshold * max(1, size - SHINGLE_WORDS + 1) - 1e-9
            starts = np.flatnonzero(seen[k:] - seen[:-k] >= enough)
            if not len(starts):
                continue
            lo, hi = int(starts[0]), int(starts[-1]) + window
            total = np.zeros((hi - lo + 1, 64), dtype=np.int32)
            np.cumsum(_signs(hashes[lo:hi]), axis=0, out=total[1:])
            prints = _pack(total[starts - lo + window] - total[starts - lo])
            pairs = [np.column_stack(self.sharing(size, own, starts, k, enough))] if self.exact else [np.empty((0, 2), np.int64)]
            for part in range(0, len(prints), PROBED):
                q, item = self.near(prints[part : part + PROBED])
                fit = self.length[item] == size
                pairs.append(np.column_stack([starts[part + q[fit]], item[fit]]))
            for s, i in np.unique(np.concatenate(pairs), axis=0).tolist():
                got = weighted_jaccard(own[s : s + k], self.shingles[i])
                if got >= self.threshold - 1e-9 and got > best.get(i, (0.0, 0, 0))[0]:
                    best[i] = (got, s, s + window)
        return sorted(((self.ids[i], s, e, got) for i, (got, s, e) in best.items()), key=lambda m: (m[0] is not None, m[0] or 0, *m[1:]))


def _matcher(index):
    """``index`` is a broadcast variable of an ItemIndex."""

    @F.arrow_udf(T.ArrayType(MATCH))
    def matched(texts: pa.Array) -> pa.Array:
        found = index.value.matches(texts)
        return pa.array([[dict(zip(MATCH.names, m, strict=True)) for m in row] for row in found], type=_ARROW)

    return matched


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", name: str = "matches", item_id: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY, in_block: int = ITEMS_IN_BLOCK, least_words: int = SHINGLE_WORDS, exact: bool = False) -> DataFrame:
    """``docs`` with an array of (item_id, start_word, end_word, similarity).

    Up to ``in_block`` items, and BYTES_IN_BLOCK bytes of them, are one index, sent to the workers, and the plan is lazy. More
    items are dealt to blocks, and each block is a pass over the texts that ends before the
    next block is fetched: its matches are written by the text's md5, and the index is
    freed. All passes' matches are then joined to the documents.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    passes = max(1, -(-n // in_block), -(-size // BYTES_IN_BLOCK))

    def sent(block: DataFrame):
        rows = block.select("i", "t").orderBy("i", "t").toArrow()
        return spark.sparkContext.broadcast(ItemIndex(rows["i"].to_pylist(), rows["t"].to_pylist(), threshold, least_words, exact))

    if passes == 1:
        return docs.withColumn(name, _matcher(sent(items))(F.col(text_col)))
    numbered = materialise(items.withColumn("r", F.monotonically_increasing_id()), "items", n)
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    found = None
    for part in range(passes):
        index = sent(numbered.filter(F.pmod(F.xxhash64("r"), F.lit(passes)) == part))
        one = docs.select(key.alias("key"), _matcher(index)(F.col(text_col)).alias("found"))
        one = materialise(one.select("key", F.explode_outer("found").alias("m")).filter("m IS NOT NULL").groupBy("key", "m").agg(F.count("*").alias("rows")), "matches")
        index.destroy()
        found = one if found is None else found.unionByName(one)
    discard(numbered)
    # A text's match stands once for each item row that holds it: copies of the text had the same.
    texts = materialise(docs.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("copies")).join(found.select("key").distinct(), "key", "left_semi"), "texts")
    times = found.join(texts, "key").select("key", F.explode(F.array_repeat("m", (F.col("rows") / F.col("copies")).cast("int"))).alias("m"))
    listed = materialise(times.groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("found")), "found")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k")).join(listed, F.col("k") == F.col("key"), "left")
    none = F.array().cast(T.ArrayType(MATCH))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != name], F.coalesce("found", none).alias(name))


_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("similarity", pa.float64())]))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each document and item it holds."""
    # explode would have its filter on empty arrays run the matching twice.
    rows = with_matches(docs, items, **options).select(F.col(id_col), F.explode_outer("matches").alias("m"))
    return rows.filter("m IS NOT NULL").select(id_col, "m.*")
