"""Connected components of a distributed edge table (alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; the component is its smallest node.

    Each round is a large and a small star operation (Kiveris et al. 2014), written
    to the shared folder. Self-loops and repeated edges are allowed and change
    nothing. Groups of any size stay distributed: only minima by node are
    aggregated, with partial sums before each shuffle. The number of edges never
    grows, so it bounds the files of each round.
    """
    oriented = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    current = materialise(oriented, "edges", edges.count())
    state = _state(current)
    for _ in range(most_rounds):
        if not state[0]:
            break
        last = current
        current = materialise(_small_star(_large_star(last)), "edges", state[0])
        discard(last)
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError("components didn't converge")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
