"""Sparse term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import WORD_TOKEN, tokens

K, B, AVERAGE = 1.2, 0.75, 256.0
# English words that carry no meaning of their own.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our "
    "ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves".split()
)


def tf_weight(tf: Column, length: Column, k: float = K, b: float = B, average: float = AVERAGE) -> Column:
    """Saturated term frequency with length normalisation; no inverse document frequency."""
    return tf * F.lit(k + 1) / (tf + F.lit(k) * (F.lit(1 - b) + F.lit(b) * length / F.lit(average)))


def counted(terms: Column) -> Column:
    """array<struct<term,tf>> of an array of terms without nulls: run lengths of the sorted array (``array_sort`` would compare by an interpreted function)."""
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
    lengths = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("bigint").alias("tf")))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return let(F.sort_array(terms), lambda s: let(starts(s), lambda at: lengths(s, at)))


def without(terms: Column, stop_words: tuple[str, ...]) -> Column:
    """An array of terms without stop words."""
    return F.filter(terms, lambda t: ~t.isin(*stop_words)) if stop_words else terms


def stored(points: DataFrame, key: str = "id", text: str = "text", keep: tuple[str, ...] = (), stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, length, terms, counts): what a collection keeps of each point's words. The key is there once, not for each
    term; the terms are one text, joined by spaces, as that packs well; weights follow from the counts."""
    split = points.select(key, *keep, without(tokens(F.col(text)), stop_words).alias("_t"))
    listed = split.select(key, *keep, F.size("_t").alias("length"), counted(F.col("_t")).alias("_p"))
    return listed.select(key, *keep, "length", F.array_join("_p.term", " ").alias("terms"), F.col("_p.tf").alias("counts"))


def weighted(stored_: DataFrame, key: str = "id", **weights) -> DataFrame:
    """(key, terms): the sparse vectors of ``stored``, as ``vectors`` gives them."""
    weight = lambda i: tf_weight(F.get("counts", i).cast("double"), F.col("length").cast("double"), **weights)
    terms = F.transform(F.split("terms", " "), lambda t, i: F.struct(t.alias("term"), weight(i).alias("weight")))
    return stored_.select(key, F.slice(terms, F.lit(1), F.size("counts")).alias("terms"))  # of no terms, the text's split is one empty one


def vectors(points: DataFrame, key: str = "id", text: str = "text", pattern: str = WORD_TOKEN, stop_words: tuple[str, ...] = (), **weights) -> DataFrame:
    """(key, terms): each point's sparse vector, an array of its distinct terms with their weights."""
    split = points.select(key, without(tokens(F.col(text), pattern), stop_words).alias("_t")).withColumn("_n", F.size("_t").cast("double"))
    weight = lambda p: tf_weight(p["tf"].cast("double"), F.col("_n"), **weights)
    return split.select(key, F.transform(counted(F.col("_t")), lambda p: F.struct(p["term"].alias("term"), weight(p).alias("weight"))).alias("terms"))


def postings(points: DataFrame, key: str = "id", text: str = "text", pattern: str = WORD_TOKEN, keep: tuple[str, ...] = (), stop_words: tuple[str, ...] = (), **weights) -> DataFrame:
    """(key, *keep, term, tf, length, weight). Stop words count neither as terms nor in the length.

    A row holds all that its weights need, so they are found in the row: nothing is
    shuffled, and only distinct terms are exploded.
    """
    split = points.select(key, *keep, without(tokens(F.col(text), pattern), stop_words).alias("_t"))
    terms = split.select(key, *keep, F.size("_t").alias("length"), F.explode(counted(F.col("_t"))).alias("_p")).select(key, *keep, "_p.term", "_p.tf", "length")
    return terms.withColumn("weight", tf_weight(F.col("tf").cast("double"), F.col("length").cast("double"), **weights))


def with_idf(postings_: DataFrame, key: str = "id") -> DataFrame:
    """Option: weights times ln(1 + (n - df + 0.5) / (df + 0.5)); not what the plain weights do."""
    n = postings_.select(key).distinct().count()
    df = postings_.groupBy("term").agg(F.count("*").alias("_df"))
    return postings_.join(df, "term").withColumn("weight", F.col("weight") * F.log1p((F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))).drop("_df")
