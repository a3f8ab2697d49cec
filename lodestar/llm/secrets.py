"""Secret scan by a trigram inverted index, with DataFrame functions only.

``trigram_query`` derives a Boolean query over trigrams from each rule's regex
(an AND over the trigrams of mandatory literals, an OR over alternatives).

1. A text is named by its md5, and equal texts are one. Names are dealt by a hash to
   segments of about SEGMENT texts.
2. ``index`` gives each segment's posting lists: for each trigram that some rule asks
   for, the names of the segment's texts that have it.
3. ``candidates`` evaluates each rule's query on a segment's lists, AND as their
   intersection and OR as their union.
4. Rows meet their candidate rules by an equi-join on the name, and a rule's regex only
   runs there. A rule without mandatory trigrams (hex) runs on all rows.

A segment's lists are bounded by its texts, so no list grows with the table, and
nothing but names and trigrams is grouped. A text that very many rows share makes one
posting; the join is a plain one, whose large partitions adaptive execution splits.

Positions are code points, end exclusive. They come from the lengths of the
pieces between matches, summed by blocks, so the cost is linear in the number
of matches.

Defined cases: a null text counts as empty; matches of a rule don't overlap and
are the leftmost ones; a match shorter than the rule's minimum is dropped but
still uses up its characters; spans of different rules may overlap and are all
kept. Repeated rows are scanned alike; a text is scanned whole, whatever its length; an empty table gives
an empty one; columns of any name pass through, but for one
that has the name of the result, which is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as parser
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.session import unused

BASE = 3
#: Trigrams taken from one literal, evenly spaced; fewer only let more candidates through.
FROM_LITERAL = 3
#: Texts of a segment of the index, about.
SEGMENT = 2048
_BLOCK = 256
#: Code points of a text's pieces when it is rewritten.
_PIECE = 2048


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` make a match count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # [0-9a-f]+ of 32 or more: runs are maximal either way.
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # A token begins where a run of its characters does, so a run is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", r"[a-z][a-z0-9+.-]{2,12}://[^\s:@/]{1,64}:[^\s:@/]{1,64}@"),
    Rule("bearer", r"(?i)authorization\x20*:\x20*bearer\x20+[A-Za-z0-9._~+/=-]{16,}"),
)


def _literal_query(strings: set[str]):
    """Query for one of ``strings`` to occur; None (always true) if one is too short."""
    if any(len(s) < 3 for s in strings):
        return None
    every = []
    for s in sorted(strings):
        grams = list(dict.fromkeys(s[k : k + 3] for k in range(len(s) - 2)))
        picked = grams if len(grams) <= FROM_LITERAL else [grams[round(k * (len(grams) - 1) / (FROM_LITERAL - 1))] for k in range(FROM_LITERAL)]
        every.append(("and", tuple(picked)))
    return every[0] if len(every) == 1 else ("or", tuple(every))


def _both(a, b):
    return b if a is None else a if b is None else ("and", (a, b))


def _walk(items, strings: set[str], query):
    """Carry the set of strings that end here, and the query so far, over a parsed sequence."""
    for op, arg in items:
        op = str(op)
        own = None
        if op == "LITERAL":
            own = {chr(arg).lower()}
        elif op == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 6:
            own = {chr(v).lower() for _, v in arg}
        elif op == "SUBPATTERN":
            strings, query = _walk(arg[3], strings, query)
            continue
        elif op == "BRANCH":
            ends = [_walk(x, {""}, None) for x in arg[1]]
            if all(q is None for _, q in ends) and all(s is not _OPEN for s, _ in ends):
                own = set().union(*(s for s, _ in ends))
            else:
                options = [_both(q, _literal_query(s)) for s, q in ends]
                query = _both(query, _literal_query(strings))
                query = query if None in options else _both(query, ("or", tuple(options)))
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            inside, more = _walk(inner, {""}, None)
            if low == 0 and high == 1 and more is None and inside is not _OPEN:
                own = inside | {""}
            elif low >= 1 and low == high and more is None and inside is not _OPEN and len(inside) ** low <= 16:
                own = {""}
                for _ in range(low):
                    own = {a + b for a in own for b in inside}
            elif low >= 1:
                query = _both(query, more)
        if own is None or len(own) * max(1, len(strings)) > 64:
            query = _both(query, _literal_query(strings)) if strings else query
            strings = _OPEN
        else:
            strings = {a + b for a in strings or {""} for b in own}
    return strings, query


_OPEN: set[str] = set()


def trigram_query(pattern: str):
    """Nested ("and" | "or", parts) over lower-case trigrams that any match must
    satisfy, or None if the regex has no mandatory trigram."""
    strings, query = _walk(parser.parse(pattern), {""}, None)
    return _both(query, _literal_query(strings)) if strings else query


def grams_of(query) -> list[str]:
    if query is None:
        return []
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(g for part in query[1] for g in grams_of(part)))


def _grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for rule in rules for g in grams_of(trigram_query(rule.pattern))})


def _held(low: Column, rules: tuple[Rule, ...]) -> Column:
    """Those of the rules' trigrams that a lower-case text has."""
    has = [F.when(low.contains(g), F.lit(g)) for g in _grams(rules)]
    return F.array_compact(F.array(*has)) if has else F.array().cast("array<string>")


def _low(text: Column) -> Column:
    """``lower`` also folds other letters than A-Z, which adds candidates only."""
    return F.lower(F.coalesce(text, F.lit("")))


def indexed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "trigrams") -> DataFrame:
    """``docs`` with the array of those trigrams of the rules' queries that the text has."""
    low = unused(docs, "low")
    return docs.withColumn(low, _low(F.col(text))).withColumn(name, _held(F.col(low), rules)).drop(low)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (trigram, id), one for each posting."""
    name = unused(docs, "trigrams")
    return indexed(docs, rules, text, name).select(F.explode(name).alias("trigram"), id_col)


def _name(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def index(texts: DataFrame, segments: int, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(segment, lists): the posting lists of each segment, a map from trigram to sorted names."""
    # A filter on the trigrams, which a plain explode has Spark infer, would look for all of them twice.
    named = texts.select(_name(F.col(text)).alias("name"), _low(F.col(text)).alias("low")).select("name", _held(F.col("low"), rules).alias("grams")).distinct()
    dealt = named.withColumn("segment", F.pmod(F.xxhash64("name"), F.lit(segments))).repartition("segment")
    lists = dealt.select("segment", "name", F.explode_outer("grams").alias("gram")).filter("gram IS NOT NULL").groupBy("segment", "gram").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return lists.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "names"))).alias("lists"))


def matching(query, lists: Column) -> Column:
    """The names that satisfy a query, from posting lists."""
    if isinstance(query, str):
        return F.coalesce(lists[query], F.array().cast("array<string>"))
    kind, parts = query
    out = matching(parts[0], lists)
    for part in parts[1:]:
        out = F.array_intersect(out, matching(part, lists)) if kind == "and" else F.array_union(out, matching(part, lists))
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(name, rules): the rules with a query that each text may match, by place."""
    asked = [(k, query) for k, rule in enumerate(rules) if (query := trigram_query(rule.pattern)) is not None]
    paired = lambda names, k: F.transform(names, lambda m: F.struct(m.alias("name"), F.lit(k).alias("rule")))
    pairs = F.concat(F.array().cast("array<struct<name:string,rule:int>>"), *[paired(matching(query, F.col("lists")), k) for k, query in asked])
    return index.select(F.explode(pairs).alias("p")).groupBy("p.name").agg(F.array_sort(F.collect_list("p.rule")).alias("rules"))


def _let(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column, first: Column, n: Column | int) -> Column:
    return F.aggregate(F.slice(values, first, n), F.lit(0), lambda t, x: t + x)


def _most(values: Column, first: Column, n: Column | int) -> Column:
    return F.coalesce(F.array_max(F.slice(values, first, n)), F.lit(0))


def _running(values: Column, of=_total) -> Column:
    """Running totals (or maxima) of an array of ints from 0; by blocks, so that long arrays stay cheap."""
    join = F.greatest if of is _most else lambda a, b: a + b
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.size(values) - 1)), lambda b: of(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    before = lambda sums: F.transform(sums, lambda _, b: of(sums, F.lit(1), b))
    running = lambda start: F.transform(values, lambda _, i: join(F.element_at(start, block(i) + 1), of(values, block(i) * _BLOCK + 1, i % _BLOCK + 1)))
    return _let(blocks, lambda sums: _let(before(sums), running))


def _spans(rule: Rule, place: int, text: Column) -> Column:
    """array<struct<start,place,end,kind>> of the rule's matches that count."""
    regex = F.lit(rule.pattern)
    lengths = lambda strings: F.transform(strings, lambda m: F.length(m))
    sizes = lengths(F.regexp_extract_all(text, regex, F.lit(0)))
    counted = lengths(F.regexp_extract_all(text, regex, F.lit(rule.group))) if rule.group else sizes
    pieces = lengths(F.split(text, rule.pattern, -1))

    def placed(size: Column) -> Column:
        gaps = F.zip_with(F.slice(pieces, F.lit(1), F.size(size)), F.concat(F.array(F.lit(0)), F.slice(size, F.lit(1), F.size(size) - 1)), lambda p, m: p + m)
        rows = F.arrays_zip(_let(gaps, lambda g: _running(g)).alias("at"), size.alias("size"), counted.alias("counted"))
        kept = F.filter(rows, lambda s: s["counted"] >= rule.least)
        return F.transform(kept, lambda s: F.struct(s["at"].alias("start"), F.lit(place).alias("place"), (s["at"] + s["size"]).alias("end"), F.lit(rule.kind).alias("kind")))

    return _let(sizes, placed)


SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with all spans, ordered by start and then by the rules' order."""
    segments = max(1, -(-docs.count() // SEGMENT))
    found = candidates(index(docs.select(F.col(text).alias("text")), segments, rules), rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _name(F.col(text)).alias("key"))
    met = rows.join(found, F.col("key") == F.col("name"), "left").select("row", F.coalesce(F.col("row")[text], F.lit("")).alias("text"), "rules")
    none = F.array().cast(SPANS)
    hits = []
    for k, rule in enumerate(rules):
        candidate = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains("rules", k), F.lit(False))
        met = met.withColumn(f"hit{k}", candidate & F.col("text").rlike(rule.pattern))
        hits.append(F.col(f"hit{k}"))
    parts = [F.when(hit, _spans(rule, k, F.col("text"))).otherwise(none) for k, (rule, hit) in enumerate(zip(rules, hits, strict=True))]
    any_hit = F.exists(F.array(*hits), lambda h: h)
    spans = F.when(any_hit, F.array_sort(F.concat(*parts))).otherwise(none).alias(name)
    return met.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != name], spans)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is cut in pieces of _PIECE."""
    within = lambda i: F.substring(F.get(pieces, i), F.greatest(start - i * _PIECE, F.lit(0)) + 1, F.least(end - i * _PIECE, F.lit(_PIECE)) - F.greatest(start - i * _PIECE, F.lit(0)))
    whole = lambda x: F.floor(x / _PIECE).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(whole(start), whole(end - 1)), within), "")).otherwise("")


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """A text with every span, or union of overlapping spans, replaced by ``mark``.

    A span is left out where one before it reaches beyond its start. Only the pieces that
    a gap lies in are read for it, so the cost is linear in text and spans.
    """
    ends = F.transform(spans, lambda s: s["end"])
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def body(cut: Column, upto: Column) -> Column:
        done = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(upto, i - 1))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= done(i), F.concat(_between(cut, done(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), _between(cut, F.element_at(upto, -1), F.length(text)))

    return _let(pieces, lambda cut: _let(_running(ends, _most), lambda upto: body(cut, upto)))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every span, or union of overlapping spans, replaced by ``mark``; in
    rows where there are some, ``length`` is set to the new number of characters."""
    name = unused(docs, "spans")
    found = with_spans(docs, rules, text, name)
    body = F.when(F.size(name) > 0, replaced(F.col(text), F.col(name), mark)).otherwise(F.col(text))
    out = found.withColumn(text, body)
    if length:
        out = out.withColumn(length, F.when(F.size(name) > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*docs.columns)
