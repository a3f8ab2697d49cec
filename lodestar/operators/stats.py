"""Status and statistics as small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.storage import materialise

_count = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def status(files: DataFrame, by: str | None = None) -> DataFrame:
    """indexed_files and total_chunks, of all or for each value of ``by``."""
    grouped = files.groupBy(by) if by else files.groupBy()
    return grouped.agg(F.count("*").alias("indexed_files"), F.coalesce(F.sum(F.col("chunk_count").cast("bigint")), F.lit(0)).alias("total_chunks"))


def health(collections: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """A row for each collection, also empty ones; pending tasks and their total over all."""
    done = files.groupBy("collection").agg(F.count("*").alias("f"), F.sum(F.col("chunk_count").cast("bigint")).alias("c"))
    waiting = tasks.groupBy("collection").agg(F.count("*").alias("p"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("bigint").alias(n)
    rows = collections.select(F.col("name").alias("collection")).join(done, "collection", "left").join(waiting, "collection", "left")
    total = tasks.agg(F.count("*").cast("bigint").alias("total_pending"))
    return rows.select("collection", zero(F.col("f"), "indexed_files"), zero(F.col("c"), "total_chunks"), zero(F.col("p"), "pending_tasks")).join(F.broadcast(total))


def task_status(tasks: DataFrame) -> DataFrame:
    """pending, queued and in_progress by collection; pending is both others together."""
    return tasks.groupBy("collection").agg(F.count("*").alias("pending"), _count(~F.col("in_progress")).alias("queued"), _count(F.col("in_progress")).alias("in_progress"))


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """The new (collection, file_path) that are accepted: each once, and none that is pending."""
    key = ["collection", "file_path"]
    return new.select(*key).distinct().join(tasks.select(*key), key, "left_anti")


def cancel(tasks: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """(tasks left, one row of removed and in_progress counts) for a collection that goes."""
    mine = F.col("collection") == collection
    counts = tasks.agg(_count(mine & ~F.col("in_progress")).alias("removed"), _count(mine & F.col("in_progress")).alias("in_progress"))
    return tasks.filter(~mine | F.col("in_progress")), counts


def chunk_count(files: DataFrame, path: str) -> DataFrame:
    """One row: the number of chunks of a file, 0 if it is unknown."""
    return files.filter(F.col("file_path") == path).agg(F.coalesce(F.max("chunk_count"), F.lit(0)).cast("bigint").alias("chunk_count"))


#: Values of a key that are sorted in one place, parts that a range of values is cut into, and rounds at most.
LEFT, PARTS, ROUNDS = 100_000, 256, 64


def _log(v: Column) -> Column:
    """Never falls where ``v`` rises, and spreads values of all sizes."""
    return F.signum(v) * F.log1p(F.abs(v))


def _at(pairs: Column, rank: Column) -> Column:
    """The pair (v, c) of an ordered array in which the running sum of c first exceeds ``rank``, with the sum before it."""
    none = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("place"))
    step = lambda t, i: F.when(t["place"].isNotNull(), t).otherwise(F.when(t["sum"] + F.get(pairs, i)["c"] > rank, F.struct(t["sum"].alias("sum"), i.cast("bigint").alias("place"))).otherwise(F.struct((t["sum"] + F.get(pairs, i)["c"]).alias("sum"), F.lit(None).cast("bigint").alias("place"))))
    return F.aggregate(F.sequence(F.lit(0), F.size(pairs) - 1), none, step)


def _values(pairs: Column, ranks: list[Column]) -> Column:
    """Struct (upto, v0, v1, ...): for each rank the first v of the ordered pairs (v, c) at which the running sum of c exceeds it."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), *[none.alias(f"v{k}") for k in range(len(ranks))])

    def step(t: Column, pair: Column) -> Column:
        upto = t["upto"] + pair["c"]
        return F.struct(upto.alias("upto"), *[F.when(t[f"v{k}"].isNull() & (upto > r), pair["v"]).otherwise(t[f"v{k}"]).alias(f"v{k}") for k, r in enumerate(ranks)])

    return F.aggregate(pairs, start, step)


def _narrowed(counted: DataFrame, targets: DataFrame, keys: list[str], logarithmic: bool) -> DataFrame:
    """Each target's range cut into PARTS, and the part that holds its rank."""
    own = counted.join(targets, keys).filter("v BETWEEN lo AND hi")
    scale = _log if logarithmic else (lambda c: c)
    lo, hi = scale(F.col("lo")), scale(F.col("hi"))
    part = F.when(hi > lo, F.least(F.lit(PARTS - 1), F.floor((scale(F.col("v")) - lo) / (hi - lo) * PARTS))).otherwise(0)
    summed = own.groupBy(*keys, "which", "rank", "below", part.alias("part")).agg(F.sum("c").alias("c"), F.count("*").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    listed = summed.groupBy(*keys, "which", "rank", "below").agg(F.sort_array(F.collect_list(F.struct("part", "c", "values", "lo", "hi"))).alias("parts"))  # PARTS of them
    found = listed.withColumn("found", _at(F.col("parts"), F.col("rank") - F.col("below"))).withColumn("own", F.get("parts", F.col("found.place").cast("int")))
    return found.select(*keys, "which", "rank", (F.col("below") + F.col("found.sum")).alias("below"), "own.lo", "own.hi", F.col("own.values").alias("values"))


def latency(samples: DataFrame, value: str = "value", by: str | None = None) -> DataFrame:
    """mean, interpolated median, p95 and p99 by position in sorted order, min, max.

    Exact order statistics without sorting a key's values: equal values are counted first, with partial sums; while a key has more
    than LEFT of them, the range that holds each position is cut into parts, by turns on a logarithmic and a linear
    scale, the parts are counted, and the one that holds the position is the next range. What is left is sorted as one array. Position
    floor(n * q) is where the running count first exceeds it. Null values don't count.
    """
    rows = samples.filter(F.col(value).isNotNull()).select(F.col(by) if by else F.lit(0).alias("_all"), F.col(value).cast("double").alias("v"))
    keys = [by or "_all"]
    counted = rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    large = rows.count()
    if large > LEFT:
        large = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    sums = [F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("values")]
    last = F.col("n") - 1
    ranks = [F.floor(last / 2), F.ceil(last / 2), F.least(F.floor(F.col("n") * 0.95), last), F.least(F.floor(F.col("n") * 0.99), last)]
    if large <= LEFT:
        listed = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("pairs"), *sums)
        found = listed.select(*keys, "mean", "min", "max", _values(F.col("pairs"), ranks).alias("s")).select(*keys, "mean", "min", "max", "s.*")
    else:
        counted = materialise(counted, "counted")
        totals = materialise(counted.groupBy(*keys).agg(*sums), "totals")
        targets = totals.select(*keys, F.posexplode(F.array(*ranks)).alias("which", "rank"), F.lit(0).cast("bigint").alias("below"), F.col("min").alias("lo"), F.col("max").alias("hi"), "values")
        for k in range(ROUNDS):
            if targets.filter((F.col("values") > LEFT) & (F.col("lo") < F.col("hi"))).isEmpty():
                break
            targets = materialise(_narrowed(counted, targets, keys, k % 2 == 0), "targets")
        own = counted.join(targets, keys).filter("v BETWEEN lo AND hi").groupBy(*keys, "which", "rank", "below").agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("pairs"))
        one = own.select(*keys, "which", _values(F.col("pairs"), [F.col("rank") - F.col("below")])["v0"].alias("v"))
        found = one.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == k, F.col("v"))).alias(f"v{k}") for k in range(4)]).join(totals, keys)
    out = found.select(*keys, "mean", ((F.col("v0") + F.col("v1")) / 2).alias("median"), F.col("v2").alias("p95"), F.col("v3").alias("p99"), "min", "max")
    return out if by else out.drop("_all")
