"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

A text is folded first: lower case, homoglyphs to the Latin letters they
imitate, digits and signs inside words to the letters they stand for, anything
else between words to one space. The automaton then finds every entry in one
pass. Entries are whole words or beginnings of words; their weights are
log-odds learned from labelled rows. An exception phrase that covers a hit
cancels it. The score is a logistic function of the summed weight, the summed
weight per 100 words, and the largest weight.

How often an entry occurs is counted in distinct contexts (neighbouring words),
not in documents: a group of copies counts once, and words that only
surround a hit in many copies of one document don't enter the lexicon.

Defined cases: null counts as empty text; an empty text has no hit and gets the
score of no hit; without training rows of both classes the lexicon is empty and
every score is the share of label 1 (0 if there is none). Repeated rows are
each scored; a text is read whole, whatever its length; an empty table gives an empty one; other columns
pass through, but for those that have the names of the results, which are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import labels as L
from lodestar.llm.session import unused
from lodestar.llm.storage import discard, materialise

#: Bound of the labelled rows the lexicon is learned from.
TRAINING_ROWS = 12_000
PREFIXES = (4, 5, 6)

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g",
    "α": "a", "ο": "o", "ρ": "p", "ι": "i", "ν": "v", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i", "ⅼ": "l",
}
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
# Harmless phrases that hold an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "class clown", "idiot proof", "sore loser")

_DROP = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_FULLWIDTH = {0xFF01 + k: chr(0x21 + k) for k in range(94)}
_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | _DROP | {k: " " for k in [*range(48), *range(58, 65), *range(91, 97), *range(123, 192)] if k != 0xAA and k != 0xAD}
_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W\d_])")
_MASKED = re.compile(r"[@$!|]")


def folded(text: str | None) -> str:
    """The text as words with one space before, between and after them."""
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_FULLWIDTH)
    if _MASKED.search(t):
        t = _SIGN.sub(lambda m: SIGNS[m[0]], t)
    return f" {' '.join(t.translate(_TABLE).split())} "


@dataclass
class Lexicon:
    """weight by entry (" word " or " beginning"); exceptions are folded phrases."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    logistic: tuple[float, ...] = (0.0, 0.0, 0.0, -20.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), float(weight)))
        for phrase in self.exceptions:
            if (key := folded(phrase)).strip():
                found.add_word(key, (len(key), None))
        if len(found):
            found.make_automaton()
        return found

    @staticmethod
    def measures(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, float, float, float]:
        """(hits, summed weight, summed weight per 100 words, largest weight). Of
        entries that begin at one word, only the heaviest counts."""
        t = folded(text)
        hits: dict[int, float] = {}
        spared = []
        if len(automaton):
            for last, (size, weight) in automaton.iter(t):
                at = last + 1 - size
                if weight is None:
                    spared.append((at, last))
                elif weight > hits.get(at, 0.0):
                    hits[at] = weight
        for a, e in spared:
            for at in [h for h in hits if a <= h < e]:
                del hits[at]
        total = sum(hits.values())
        return len(hits), total, 100 * total / max(1, t.count(" ") - 1), max(hits.values(), default=0.0)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entries(text: str | None) -> list[tuple[str, int]]:
    """Distinct (entry, context) of a text; the context is a hash of both neighbours."""
    words = folded(text).split(" ")
    got = set()
    for k in range(1, len(words) - 1):
        w = words[k]
        if len(w) >= 3:
            context = hash_pair(words[k - 1], words[k + 1])
            got.add((f" {w} ", context))
            for p in PREFIXES:
                if len(w) > p:
                    got.add((f" {w[:p]}", context))
    return list(got)


def hash_pair(a: str, b: str) -> int:
    """A hash that doesn't depend on the interpreter's seed."""
    x = 1469598103
    for c in f"{a} {b}".encode():
        x = (x * 16777619 ^ c) & 0x7FFFFFFF
    return x


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAINING_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS, least: int = 4, least_odds: float = 2.5) -> Lexicon:
    """Learn entries and the logistic function from at most ``limit`` labelled rows.

    An entry is kept if it has ``least`` contexts or more under label 1, its
    smoothed log-odds are ``least_odds`` or more, and its log-likelihood ratio
    is significant. The lexicon holds all entries that are, so only the labelled rows
    bound it. Equal rows give equal lexicons, whatever their order.
    """
    rows = materialise(L.training_rows(docs, labels, label, limit), "labelled")

    @F.arrow_udf("array<struct<entry:string,context:int>>")
    def listed(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("entry", pa.string()), ("context", pa.int32())]))
        return pa.array([[{"entry": e, "context": c} for e, c in _entries(t)] for t in text.to_pylist()], type=kind)

    pairs = rows.select("y", F.explode(listed("text")).alias("e")).select("y", "e.entry", "e.context").distinct()
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sum(n for y, n in totals.items() if y > 0.5), sum(n for y, n in totals.items() if y <= 0.5)
    lexicon = Lexicon(exceptions=exceptions)
    if not n1 or not n0:
        lexicon.logistic = (0.0, 0.0, 0.0, 20.0 if n1 else -20.0)
        discard(rows)
        return lexicon
    a, b = F.sum(F.when(F.col("y") > 0.5, 1).otherwise(0)), F.sum(F.when(F.col("y") <= 0.5, 1).otherwise(0))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    got = (
        pairs.groupBy("entry").agg(a.alias("a"), b.alias("b")).withColumn("odds", odds)
        .filter((F.col("a") >= least) & (F.col("odds") >= least_odds) & (F.col("a") * F.col("odds") >= 12))
        .collect()
    )
    lexicon.weights = {e: round(w, 4) for e, w in sorted((r["entry"], r["odds"]) for r in got)}
    m = measured(rows, lexicon).select("y", "m.*").toPandas().sort_values(["y", "total", "per_100", "top"])
    discard(rows)
    x = np.column_stack([np.log1p(m["total"]), np.log1p(m["per_100"]), m["top"]])
    lexicon.logistic = tuple(float(v) for v in _logistic(x, m["y"].to_numpy()))
    return lexicon


def measured(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "m") -> DataFrame:
    """``docs`` with a struct of hits, total, per_100 and top."""

    @F.arrow_udf("struct<hits:int,total:double,per_100:double,top:double>")
    def measure(column: pa.Array) -> pa.Array:
        automaton = _automaton(lexicon)
        got = [Lexicon.measures(t, automaton) for t in column.to_pylist()]
        cols = list(zip(*got, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(cols, (pa.int32(), *[pa.float64()] * 3), strict=True)], ["hits", "total", "per_100", "top"])

    return docs.withColumn(name, measure(F.col(text)))


_built: list = []


def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    """Built once for each lexicon and Python worker."""
    if not _built or _built[0] is not lexicon:
        _built[:] = [lexicon, lexicon.automaton()]
    return _built[1]


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 and the number of hits."""
    a, b, c, d = lexicon.logistic
    m = unused(docs, "m")
    margin = a * F.log1p(F.col(m)["total"]) + b * F.log1p(F.col(m)["per_100"]) + c * F.col(m)["top"] + d
    return measured(docs, lexicon, text, m).withColumn(name, 1 / (1 + F.exp(-margin))).withColumn(f"{name}_hits", F.col(m)["hits"]).drop(m)
