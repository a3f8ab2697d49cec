"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Five-word shingles weighted by their count in the text. Each shingle has a
Poisson process of arrivals whose rate is its weight; each arrival falls on one
of ``ROWS * BANDS`` components, and a component keeps the shingle that arrived
first. Two texts agree in a component with the probability Jaccard similarity
J_P of their weights (Moulton & Jiang 2018, Ertl 2020). A shingle is dropped
as soon as its next arrival is later than all components' first ones.

1. Texts with the same words collapse to one node, whatever their ids.
2. Bands of the nodes' signatures give buckets; each member of a bucket is
   paired with the bucket's smallest node, its centre. Pairs whose signatures agree
   in too few components are out; the others are verified by exact J_P. A centre's
   members are dealt in blocks of bounded size, and its text goes once to each block.
3. Verified links give components. A bucket whose members are still in several
   components may hide a link between two members of which neither is its
   centre. Such divided buckets have further rounds with other centres, a different one
   for each band, so the members of a large group meet up to BANDS centres at once.
4. In buckets that are still divided, members across components are compared by
   signature, in blocks; those that agree enough are verified there by exact J_P,
   and only links leave the task. Members of a bucket's largest component
   meet only the others, so the work is near linear where few are left over.
5. Components again, over all links. Only then a class gets its smallest id.

No group is capped or sampled, and no pairs are written: rows grow with members and
links. Blocks are bounded by their shingles, not by rows, so a task's memory is that of
two blocks, or of its longest text. A link can only be missed where no band holds both texts, or where the
signatures of two near-duplicates agree in too few components.

Defined cases: a null text, or one without words, is a class of its own; texts
of 1-4 words have one shingle of all words. The class id is the smallest id of
the class, null if no row of it has an id. Different texts under one id are
matched each for itself; two classes whose smallest id is the same have the same
class id. Repeated rows are in one class. A text is read whole by one task, whatever its length; an empty table
gives an empty one. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.components import components
from lodestar.llm.storage import discard, materialise
from lodestar.llm.textops import U, batches_of_words, mix, sequence_hash, weighted_shingles

SIMILARITY = 0.8
ROWS, BANDS = 4, 20
SIZE = ROWS * BANDS
#: Signatures that agree in fewer components than this are not verified: at
#: J_P = 0.8 that is over five standard deviations below the mean.
LEAST_AGREEING = 44
#: Members of a block whose signatures a task compares, and a block's distinct shingles where texts are compared.
BLOCK, SET_BLOCK = 2048, 1 << 18
#: Shingles, and pairs of signatures, that are compared at once.
SET_SLICE, PAIRS_AT_ONCE = 1 << 18, 1 << 18
#: Blocks that a task is to have, and the most tasks of a stage; a task streams its blocks, so more of them take no more memory.
BLOCKS_IN_TASK, MOST_TASKS = 8, 100_000
#: Narrow rows that a row with a signature counts as, when files are sized.
WIDE = 8
#: Further rounds with other centres, before all pairs of a divided bucket are compared.
MORE_STARS = 3


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """(n, size) array of the elements that arrive first; 0 for a text without elements."""
    first = np.full(n * size, np.inf)
    kept = np.zeros(n * size, dtype=U)
    count = np.bincount(doc, minlength=n)
    lone = count[doc] == 1  # a single element holds every component
    kept.reshape(n, size)[doc[lone]] = element[lone][:, None]
    doc, element, weight = doc[~lone], element[~lone], weight[~lone]
    time = np.zeros(len(doc))
    round_ = 0
    while len(doc):
        random = mix(element * U(0x9E3779B97F4A7C15) + U(0xA0761D6478BD642F * (2 * round_ + 1) & (2**64 - 1)))
        time = time - np.log(((random >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * size + ((mix(random) >> U(32)) * U(size) >> U(32)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        kept[slot[won]] = element[won]
        some = np.unique(doc)
        last = np.zeros(n)
        last[some] = first.reshape(n, size)[some].max(1)
        on = time < last[doc]
        doc, element, weight, time = doc[on], element[on], weight[on], time[on]
        round_ += 1
    return kept.reshape(n, size)


def probability_jaccard(ea: np.ndarray, wa: np.ndarray, eb: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets given as sorted distinct elements and weights."""
    both, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    ratios, n = np.unique(np.column_stack([wa[ia], wb[ib]]), axis=0, return_counts=True)
    return float(sum(c / (only_a / x + only_b / y + np.maximum(wa[ia] / x, wb[ib] / y).sum()) for (x, y), c in zip(ratios.tolist(), n.tolist(), strict=True)))


PRINT = T.StructType().add("h1", T.LongType()).add("h2", T.LongType()).add("size", T.IntegerType()).add("bands", T.ArrayType(T.LongType()))


@F.arrow_udf(PRINT)
def _fingerprint(text: pa.Array) -> pa.Array:
    """Hashes of the words, number of distinct shingles, and the signature: a band of
    ROWS 16-bit components is one long."""
    hashes, sizes, marks = [], [], []
    for at, end, words in batches_of_words(text):
        doc, element, weight = weighted_shingles(words)
        hashes.append(sequence_hash(words))
        sizes.append(np.bincount(doc, minlength=end - at))
        marks.append(mix(signatures(doc, element, weight, end - at)).astype(np.uint16))
    h = np.concatenate(hashes) if hashes else np.empty((0, 2), U)
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    bands = np.ascontiguousarray(np.concatenate(marks)).view(np.int64).ravel() if marks else np.empty(0, np.int64)
    listed = pa.ListArray.from_arrays(np.arange(0, len(h) * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands))
    return pa.StructArray.from_arrays([pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64)), pa.array(size.astype(np.int32)), listed], PRINT.names)


def _longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)


def _sets(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, end, words in batches_of_words(text):
        doc, element, weight = weighted_shingles(words)
        cut = np.searchsorted(doc, np.arange(end - at + 1))
        for k in range(end - at):
            yield element[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]]


def _near(ea: np.ndarray, wa: np.ndarray, eb: np.ndarray, wb: np.ndarray, threshold: float) -> bool:
    """Whether J_P is ``threshold`` or more."""
    if len(ea) > len(eb):
        ea, wa, eb, wb = eb, wb, ea, wa
    if not len(ea):
        return False
    at = np.minimum(np.searchsorted(eb, ea), len(eb) - 1)
    shared = eb[at] == ea
    ma, mb = wa.sum(), wb.sum()
    if ma == len(ea) and mb == len(eb):  # no repeated shingle: J_P is the share of common ones
        both = int(shared.sum())
        return both / (len(ea) + len(eb) - both) >= threshold - 1e-9
    # J_P is at most the shared part of either side's mass.
    if min(wa[shared].sum() / ma, wb[at[shared]].sum() / mb) < threshold - 1e-9:
        return False
    return probability_jaccard(ea, wa, eb, wb) >= threshold


def _hopeful(sets: list, x: int, ys: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``ys`` have so much mass in common with ``x`` that J_P may be ``threshold``."""
    ex, wx = sets[x]
    e, w = (np.concatenate([sets[y][k] for y in ys.tolist()]) for k in (0, 1))
    of = np.repeat(np.arange(len(ys)), [len(sets[y][0]) for y in ys.tolist()])
    at = np.minimum(np.searchsorted(ex, e), len(ex) - 1)
    shared = ex[at] == e
    mass = lambda v: np.bincount(of, v, len(ys))
    mine, theirs = mass(wx[at] * shared) / wx.sum(), mass(w * shared) / mass(w)
    plain = (wx.sum() == len(ex)) & (mass(w) == mass(np.ones(len(w))))
    both = mass(shared.astype(float))
    return np.where(plain, both / (len(ex) + mass(w) - both), np.minimum(mine, theirs)) >= threshold - 1e-9


# ---- pairs of a bucket's centre and its members ------------------------------------------------


def _agreeing(least: int):
    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose signatures agree enough. A centre (b is null) stands before its members."""
        centre = np.zeros(SIZE, np.uint16)
        for batch in batches:
            is_centre = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            marks = _longs(batch.column("value")).view(np.uint16)
            at = np.maximum.accumulate(np.where(is_centre, np.arange(len(marks)), -1))
            against = marks[np.maximum(at, 0)]
            against[at < 0] = centre
            ok = ~is_centre & ((marks == against).sum(1) >= least)
            yield batch.select(["a", "b", "size"]).filter(pa.array(ok))
            if len(at) and at[-1] >= 0:
                centre = marks[at[-1]].copy()

    return agreeing


def _similar(threshold: float):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose texts have J_P of ``threshold`` or more. Holds one centre's set and a slice of the members'."""
        centre: tuple = ()
        for batch in batches:
            is_centre = batch.column("b").is_null().to_pylist()
            ok = np.zeros(len(is_centre), dtype=bool)
            for k, (e, w) in enumerate(_sets(batch.column("value"))):
                if is_centre[k]:
                    centre = e.copy(), w.copy()
                else:
                    ok[k] = _near(*centre, e, w, threshold)
            yield batch.select(["a", "b", "size"]).filter(pa.array(ok))

    return similar


def _beside_centres(pairs: DataFrame, values: DataFrame, value: str, kernel, limit: int) -> DataFrame:
    """Rows of pairs(a, b, size) that ``kernel`` passes, from the ``value`` of both.

    A centre's members are dealt in blocks of about ``limit`` in sum of sizes. The
    centre's value goes once to each block, and each member's to its own only; a task
    reads a block as a stream.
    """
    total = pairs.agg(F.sum("size")).first()[0] or 0
    hot = materialise(pairs.groupBy("a").agg(F.sum("size").alias("total")).filter(F.col("total") > limit).select("a", F.ceil(F.col("total") / limit).alias("blocks")), "hot", total // limit)
    dealt = pairs.join(hot, "a", "left").select("a", "b", "size", F.coalesce(F.pmod(F.xxhash64("b"), "blocks"), F.lit(0)).alias("block"))
    own = values.select(F.col("node").alias("n"), F.col(value).alias("value"))
    members = dealt.join(own, F.col("b") == F.col("n")).select("a", "block", "b", "size", "value")
    centres = dealt.select("a", "block").distinct().join(own, F.col("a") == F.col("n")).select("a", "block", F.lit(None).cast("bigint").alias("b"), F.lit(0).alias("size"), "value")
    rows = members.unionByName(centres).repartition(_tasks(pairs, total, limit), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return rows.mapInArrow(kernel, "a bigint, b bigint, size int")


def _tasks(df: DataFrame, total: int, block: int) -> int:
    """Tasks of some blocks each, for blocks of ``total`` in all. A row here is more work
    than its bytes tell, so adaptive execution isn't to merge them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total // (BLOCKS_IN_TASK * block), MOST_TASKS))


def _linked(pairs: DataFrame, marks: DataFrame, sources: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) of pairs(a, b, size)."""
    likely = materialise(_beside_centres(pairs, marks, "bands", _agreeing(_least(threshold)), SET_BLOCK), "pairs", pairs.count(), heavy=True)
    links = materialise(_beside_centres(likely, sources, "text", _similar(threshold), SET_BLOCK).select("a", "b"), "links", likely.count(), heavy=True)
    discard(pairs, likely)
    return links


def _least(threshold: float) -> int:
    return int(LEAST_AGREEING * min(1.0, threshold / SIMILARITY))


# ---- all pairs across the components of a bucket -----------------------------------------------


def _dealt(members: DataFrame, weight: str, limit: int) -> DataFrame:
    """Members(band, key, node, component, ...) of buckets, dealt to groups ``g``.

    The members of a bucket's largest component are cut in blocks, and so are all others
    (the minor ones), by about ``limit`` in sum of weights. Each minor block meets each
    other block in one group, as its ``side`` 0; with the first block of the largest
    component it also meets itself (``within``). So where the minor members fit in one
    block, each member of the largest component goes to one group only.
    """
    parts = members.groupBy("band", "key", "component").agg(F.sum(weight).alias("w"))
    whole = parts.groupBy("band", "key").agg(F.max(F.struct("w", "component")).alias("m"), F.sum("w").alias("w"))
    ceil = lambda w: F.greatest(F.lit(1), F.ceil(w / limit)).cast("int")
    by = whole.select("band", "key", F.col("m.component").alias("major"), ceil(F.col("m.w")).alias("majors"), ceil(F.col("w") - F.col("m.w")).alias("minors"))
    by = materialise(by, "blocks", members.count() // 2)
    minor = F.col("component") != F.col("major")
    own = members.join(by, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.when(minor, F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    group = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), F.lit(side).alias("side"))
    of_major = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: group(i, F.col("minors") + F.col("block"), 1))
    beside = F.transform(F.sequence(F.col("block") + 1, F.col("minors") + F.col("majors") - 1), lambda i: group(F.col("block"), i, 0))
    under = F.transform(F.slice(F.sequence(F.lit(0), F.col("block")), F.lit(1), F.col("block")), lambda i: group(i, F.col("block"), 1))
    met = own.withColumn("to", F.explode(F.when(minor, F.concat(beside, under)).otherwise(of_major)))
    columns = [c for c in members.columns if c not in ("band", "key")]
    return met.select(F.xxhash64("band", "key", "to.low", "to.high").alias("g"), F.col("to.side").alias("side"), (F.col("to.high") == F.col("minors")).alias("within"), "band", "key", *columns)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``g``, which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for at, end in pairwise(cuts):
            if held and held[0].column("g")[0].as_py() != g[at]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _likely_across(group: pa.Table, place: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a group whose signatures agree enough across components. A pair
    that shares several buckets is only met in that of its first band."""
    longs = _longs(group.column("bands").chunk(0))
    low = longs.view(np.uint16).astype(np.uint8)  # half the bits tell nearly as much
    band, side = group.column("band")[0].as_py(), group.column("side").to_numpy()
    ones = np.arange(len(side)) if group.column("within")[0].as_py() else np.flatnonzero(side == 1)
    columns = np.ascontiguousarray(low[ones].T)
    step = max(1, PAIRS_AT_ONCE // max(1, len(ones)))
    zeros = np.flatnonzero(side == 0)
    for at in range(0, len(zeros), step):
        x = zeros[at : at + step]
        if len(x) * len(ones) <= 2048:
            agree = (low[x][:, None] == low[ones][None]).sum(2)
        else:
            agree = np.zeros((len(x), len(ones)), dtype=np.uint8)
            for mine, theirs in zip(low[x].T, columns, strict=True):
                agree += mine[:, None] == theirs
        row, y = np.nonzero((agree >= least) & (place[x, None] != place[ones]))
        row, y = row, ones[y]
        same = longs[x[row]] == longs[y]
        first = same.any(1) & (same.argmax(1) == band)
        row, y = row[first], y[first]
        cut = np.searchsorted(row, np.arange(len(x) + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            yield int(x[k]), y[cut[k] : cut[k + 1]]


def _places(group: pa.Table) -> np.ndarray:
    return np.unique(group.column("component").to_numpy(), return_inverse=True)[1]


def _in_question(least: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each group that have a likely partner across."""
        for group in _whole_groups(batches):
            flagged = np.zeros(len(group), dtype=bool)
            for x, ys in _likely_across(group, _places(group), least):
                flagged[ys] = flagged[x] = True
            if flagged.any():
                yield from group.select(["band", "key", "node"]).filter(pa.array(flagged)).to_batches()

    return asked


def _links_within(threshold: float):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verified links of each group. Rows that a link has brought into one component
        aren't compared any more, so that links grow with rows."""
        for group in _whole_groups(batches):
            place = _places(group)
            sets = list(_sets(group.column("text").chunk(0)))
            size = np.array([len(e) for e, _ in sets])
            node, out = group.column("node").to_pylist(), []
            for x, ys in _likely_across(group, place.copy(), _least(threshold)):
                ys = ys[place[ys] != place[x]]
                part = np.cumsum(size[ys]) // SET_SLICE
                for k in np.unique(part).tolist():
                    some = ys[part == k]
                    for y in some[_hopeful(sets, x, some, threshold)].tolist():
                        if place[y] != place[x] and _near(*sets[x], *sets[y], threshold):
                            out.append((min(node[x], node[y]), max(node[x], node[y])))
                            place[place == place[y]] = place[x]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return linked


def _across(divided: DataFrame, sources: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) across components in divided buckets(band, key, node, component, size, bands).

    Signatures settle which members are in question; only these meet again with
    their texts. Each group holds two blocks at most, and only links leave it.
    """
    grouped = lambda df, n: df.repartition(n, "g").sortWithinPartitions("g")
    rows = divided.count()
    asked = grouped(_dealt(divided.withColumn("one", F.lit(1)), "one", BLOCK).drop("size", "one"), _tasks(divided, rows, BLOCK)).mapInArrow(_in_question(_least(threshold)), "band int, key bigint, node bigint")
    asked = materialise(asked.distinct(), "asked", rows)
    again = materialise(divided.join(asked, ["band", "key", "node"]), "again", asked.count())
    discard(asked)
    total = again.agg(F.sum("size")).first()[0] or 0
    texts = _dealt(again, "size", SET_BLOCK).join(sources, "node").drop("size", "key")
    return grouped(texts, _tasks(divided, total, SET_BLOCK)).mapInArrow(_links_within(threshold), "a bigint, b bigint").distinct()


def _named(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """One row per row of ``docs``: (id, t, part, class_id). ``t`` is a hash of the text,
    ``part`` tells classes apart that have the same id; it is null for a text without words."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    prints = materialise(texts.select("id", "t", _fingerprint("text").alias("f")).select("id", "t", "f.*"), "prints")
    worded = prints.filter("size > 0")
    # The signature is a function of the words, so any row's will do. A row's id and text are where a node's text is found.
    row = F.struct(F.col("id").isNull().alias("nameless"), "id", "t")
    exact = worded.groupBy("h1", "h2").agg(F.min(row).alias("row"), F.first("size").alias("size"), F.any_value("bands").alias("bands"))
    nodes = materialise(exact.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "row.id", "row.t", "size", "bands"), "exact", WIDE * prints.count())
    rows = prints.count()
    banded = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    # Sums by key are written before they are joined: only a join of plain exchanges can be split where a key is hot.
    buckets = materialise(banded.groupBy("band", "key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).filter("centre <> other").drop("other"), "buckets", rows * BANDS // 2)
    members = materialise(banded.join(buckets, ["band", "key"]), "members", rows * BANDS)
    discard(buckets)
    marks = nodes.select("node", "bands")
    # Texts of bucket members only, one of each.
    involved = members.select("node").distinct().join(nodes, "node").select("node", F.col("id").alias("_id"), F.col("t").alias("_t"))
    sources = texts.join(involved, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).groupBy("node").agg(F.min("text").alias("text"))
    sources = materialise(sources, "texts")
    star = materialise(members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), "size").distinct(), "star", members.count())
    links = _linked(star, marks, sources, threshold)
    parts = components(links)
    divided = _divided(members, parts)
    for seed in range(MORE_STARS):
        # Each bucket has another centre, so a large group has up to BANDS of them at once.
        other = F.min_by(F.struct("node", "component"), F.xxhash64(F.lit(seed), "band", "node"))
        centres = divided.groupBy("band", "key").agg(other.alias("c"), F.count("*").alias("rows")).filter(F.col("rows") > (0 if seed == 0 else BLOCK))
        centres = materialise(centres, "centres", divided.count() // 2)
        apart = divided.join(centres, ["band", "key"]).filter(F.col("component") != F.col("c.component"))
        star = materialise(apart.select(F.col("c.node").alias("a"), F.col("node").alias("b"), "size").distinct(), "star", divided.count())
        if star.isEmpty():
            break
        found = _linked(star, marks, sources, threshold)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        parts = components(links)
        discard(divided)
        divided = _divided(members, parts)
    unsettled = materialise(divided.join(marks, "node"), "unsettled", WIDE * divided.count())
    more = materialise(_across(unsettled, sources, threshold), "links", divided.count())
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    discard(members, sources, divided, unsettled)
    smallest = parts.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    linked = parts.join(smallest, "component").select("node", "component", "least")
    named = nodes.join(linked, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("part"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("class_id"))
    lone = prints.filter("size = 0").select("id", "t", F.lit(None).cast("bigint").alias("part"), F.col("id").alias("class_id"))
    return worded.join(named, ["h1", "h2"]).select("id", "t", "part", "class_id").unionByName(lone)


def _divided(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(band, key, node, size, component) of the members of buckets that hold several components."""
    placed = members.join(parts, "node", "left").select("band", "key", "node", "size", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("band", "key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("band", "key")
    several = materialise(several, "several", members.count() // 2)
    return materialise(placed.join(several, ["band", "key"], "left_semi"), "divided", members.count())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: (id, class_id)."""
    return _named(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id")


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, nameless_apart: bool = True) -> DataFrame:
    """Rows of ``docs`` to keep: of each class, the one with the smallest id.

    Of rows of a class that share that id, the one whose text sorts first stays.
    With ``nameless_apart`` rows without an id don't compete with those that have one:
    of those of a class, the one whose text sorts first stays too. Without it, they
    stay only in a class where no row has an id. Of rows without words, one of
    each id stays, and one of each text of those without an id. Columns of any name
    pass through.
    """
    best = F.col("id").eqNullSafe(F.col("class_id"))
    named = materialise(_named(docs, id_col, text_col, threshold).filter(best | F.col("id").isNull() if nameless_apart else best), "classes", docs.count())
    # Rivals: rows of a class and id; without words, of an id; without both, of a text.
    lone = F.when(F.col("part").isNull() & F.col("id").isNull(), F.col("t"))
    keys = named.groupBy("id", "t").agg(F.min("part").alias("part"), F.count("*").alias("n")).withColumn("lone", lone)
    keys = keys.withColumn("rivals", F.sum("n").over(Window.partitionBy("part", "id", "lone")))
    keys = materialise(keys.select("id", "t", "part", "lone", "rivals"), "keys", named.count())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    kept = rows.join(keys, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("t")))
    if not keys.filter("rivals > 1").isEmpty():
        first = Window.partitionBy("part", "id", "lone").orderBy(F.col("row")[text_col])
        again = kept.filter("rivals > 1").withColumn("place", F.row_number().over(first)).filter(F.col("place") == 1).drop("place")
        kept = kept.filter("rivals = 1").unionByName(again)
    return kept.select("row.*")
