"""Chat formatting after collapsing cumulative snapshots.

A logged conversation that is a prefix of a longer one (the same turns, role and
text) is dropped, and of equal conversations the one with the smallest id stays.

Each conversation has, for each of its turns, a hash of all turns so far. It is
a sum of turn hashes, each mixed with its position, so it is found by sums
alone: conversations are cut into runs of RUN turn numbers, sums are taken within a run
and over the totals of runs. A conversation with a third of all rows is dealt out by
its runs; turns of one number are sorted by one task, which spills where they are many.
Whole-conversation hashes that are proper prefixes' too are dropped by an anti-join.
Both sides are aggregated by hash first, so a first turn that very many
conversations share is one row.

All this works on two hashes of each turn. Texts are joined to the runs of kept
conversations only, and are formatted where they arrive; a part that lies in
one run doesn't move again. (Where turns of a conversation agree in number and role,
their order needs the text, and only then it is sorted with the hashes.)

Rendering gives one row for each RUN turns of a kept conversation: ``part`` counts
from 0, and the parts' texts in order are the conversation's text.

Defined cases: turns are ordered by number, then role, then text, nulls first;
turn numbers may repeat or have gaps, only the order counts; a null role renders
as "unknown" and a null text as empty, and both are hashed apart from these
words; rows with a null conversation id are one conversation. Repeated rows are
repeated turns. Texts are taken whole, whatever their length; an empty table gives an empty one. Other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.storage import materialise

RUN = 256
SEEDS = (11, 29)
TEMPLATE = ("<|{role}|>\n", "\n<|end|>\n")


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, run, turn, role, text): runs by turn number; repeated numbers share a run. The
    key is a struct, which is equal to another one where both ids are null."""
    return turns.select(F.struct(F.col(conv).alias("id")).alias("c"), F.floor(F.coalesce(F.col(turn), F.lit(-1)) / RUN).alias("run"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


def _runs(rows: DataFrame) -> DataFrame:
    """(c, run, before, n) of each run: the turns before it, and all of its conversation's."""
    counts = rows.groupBy("c", "run").agg(F.count("*").alias("k"))
    every = Window.partitionBy("c")
    upto = every.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("c", "run", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("before"), F.sum("k").over(every).alias("n"))


def _wrapped(total: Column) -> Column:
    """A sum of 62-bit numbers, held as decimal, back to a long."""
    return F.pmod(total, F.lit(1 << 62).cast("decimal(38,0)")).cast("bigint")


def prefixes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(c, place, n, a, b): each turn's place from 0, the number of turns of its
    conversation, and the two hashes of the turns up to it."""
    content = [F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(name) for seed, name in zip(SEEDS, "xy", strict=True)]
    tied = not rows.groupBy("c", "turn", "role").agg(F.count("*").alias("k")).filter("k > 1").isEmpty()
    order = ["turn", "role", *(["text"] if tied else [])]
    narrow = rows.select("c", "run", *order, *content).join(runs, ["c", "run"])
    inside = Window.partitionBy("c", "run").orderBy(*order)
    placed = narrow.withColumn("place", F.row_number().over(inside) + F.col("before") - 1)
    own = [F.pmod(F.xxhash64(F.lit(seed), "place", "x", "y"), F.lit(1 << 62)).cast("decimal(38,0)").alias(name) for seed, name in zip(SEEDS, "xy", strict=True)]
    hashed = materialise(placed.select("c", "run", "place", "n", *own), "turns")
    earlier = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("c", "run").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    before = totals.select("c", "run", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in "xy"])
    upto = Window.partitionBy("c", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.join(before, ["c", "run"])
    return rolled.select("c", "place", "n", _wrapped(F.sum("x").over(upto) + F.col("x_before")).alias("a"), _wrapped(F.sum("y").over(upto) + F.col("y_before")).alias("b"))


def maximal(rolled: DataFrame) -> DataFrame:
    """(c, turns) of the conversations to keep, from ``prefixes``."""
    last = F.col("place") == F.col("n") - 1
    whole = rolled.filter(last).groupBy("place", "a", "b").agg(F.min(F.struct(F.col("c.id").isNotNull().alias("named"), "c")).alias("kept"), F.max("n").alias("turns"))
    proper = rolled.filter(~last).select("place", "a", "b").distinct()
    return whole.join(proper, ["place", "a", "b"], "left_anti").select("kept.c", "turns")


def rendered(turns: DataFrame, template: tuple[str, str] = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, turns, n, text): the parts of each maximal conversation; ``turns`` is
    the conversation's number of turns, ``n`` the part's."""
    rows = _rows(turns, conv, turn, role, text)
    runs = materialise(_runs(rows), "runs")
    kept = materialise(maximal(materialise(prefixes(rows, runs), "prefixes")), "kept")
    head, tail = template
    opening = F.concat(*_split(head, F.coalesce("role", F.lit("unknown"))))
    piece = F.concat(opening, F.coalesce("text", F.lit("")), F.lit(tail))
    inside = Window.partitionBy("c", "run").orderBy("turn", "role", "text")
    place = F.row_number().over(inside) + F.col("before") - 1
    placed = rows.join(runs.select("c", "run", "before").join(kept, "c"), ["c", "run"]).select("c", "run", "turns", place.alias("place"), piece.alias("s"))
    part = F.floor(F.col("place") / RUN).alias("part")
    parts = placed.groupBy("c", "run", "turns", part).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "s"))).alias("s"))
    parts = parts.withColumn("text", F.array_join(F.transform("s", lambda x: x["s"]), "")).drop("s")
    whole = F.col("n") == F.least(F.lit(RUN), F.col("turns") - F.col("part") * RUN)
    joined = parts.filter(~whole).groupBy("c", "turns", "part").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("run", "text"))).alias("s"))
    columns = [F.col("c.id").alias(conv), "part", F.col("turns").cast("bigint").alias("turns"), "n"]
    return parts.filter(whole).select(*columns, "text").unionByName(joined.select(*columns, F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text")))


def _split(head: str, role: Column) -> list[Column]:
    before, _, after = head.partition("{role}")
    return [F.lit(before), role, F.lit(after)] if "{role}" in head else [F.lit(head)]
