"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import codes, exact, queries, runs

SF = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

# ---- 11 vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([1, 3, 1000, 1 << 27]))
def test_tree_equals_brute_force(seed, k, spread):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (k, 4))
    points = np.vstack([rng.integers(-spread, spread + 1, (200, 4)), entries])
    entry, square = codes.Tree(entries).nearest(points)
    want = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    assert entry.tolist() == want.argmin(1).tolist()  # argmin takes the first of equals
    assert square.tolist() == want.min(1).tolist()


def test_tree_passes_entries_over():
    """Far halves aren't looked at: fewer distances than entries times points."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-4000, 4000, (64, 2))
    points = rng.integers(-4000, 4000, (500, 2))
    seen, squares = [], codes._squares
    codes._squares = lambda p, e: (seen.append(len(p)), squares(p, e))[1]
    try:
        tree = codes.Tree(entries)
        seen.clear()
        tree.nearest(points)
    finally:
        codes._squares = squares
    assert sum(seen) < 0.6 * len(entries) * len(points)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted([(i is None, i or 0, v, label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)])
    ints = [[int(np.floor(4096 * x)) for x in v] for _, _, v, _ in kept]
    size = len(ints[0]) // parts
    cut = [[tuple(v[j * size : (j + 1) * size]) for j in range(parts)] for v in ints]
    books = [[cut[r][j] for r in range(min(entries, len(cut)))] for j in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, book: min((dist(p, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[near(v[j], books[j])[1]].append(v[j])
            books[j] = [tuple(sum(x) // len(own[k]) for x in zip(*own[k], strict=True)) if own[k] else e for k, e in enumerate(books[j])]
    out = []
    for (none, i, _, label), v in zip(kept, cut, strict=True):
        got = [near(v[j], books[j]) for j in range(parts)]
        out.append((None if none else i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return [(i, code, e, sums[label], digest) for i, code, e, label in out]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    make = lambda: rng.normal(0, 0.3, 16).astype(np.float32).tolist()
    rows = [(i, make(), int(rng.integers(3)) if i % 7 else None) for i in range(120)]
    rows += [(500, rows[3][1], 1), (501, rows[3][1], None), (502, None, 1), (503, [float("nan")] * 16, 1), (504, [float("inf")] + [0.0] * 15, 2), (505, [None] + [0.0] * 15, 2), (506, [0.0] * 16, 2), (None, make(), 0), (506, make(), 2)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted(map(tuple, codes.compressed(df).collect()), key=repr)
    assert got == sorted(brute_codes(rows), key=repr)


def test_codes_cases(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.compressed(empty).collect() == []
    few = spark.createDataFrame([(2, [0.5] * 8, None), (1, [0.25] * 8, 4), (3, [0.5] * 9, 4), (4, [], 4)], VECTORS)
    assert sorted((r.vec_id, r.code, r.error) for r in codes.compressed(few).collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        codes.train(spark.createDataFrame([(1, [1.0] * 9, 1)], VECTORS))
    with pytest.raises(Exception, match="a component is beyond"):
        codes.train(spark.createDataFrame([(1, [1e9] * 8, 1)], VECTORS))
    clash = few.withColumn("code", F.lit("x")).withColumn("Found", F.lit("y"))
    got = codes.encode(clash, codes.train(few))
    assert got.columns == ["vec_id", "embedding", "label", "Found", "code", "error"] and {r.Found for r in got.collect()} == {"y"}


@with_data
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_exact_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- 12 exact duplicates

TEXTS = "doc_id long, text string"


def brute_groups(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in of.items()}
    out, done = [], set()
    for i, t in rows:
        t = t or ""
        kept = i == keep[t] and t not in done
        if kept:
            done.add(t)
        out.append((i, keep[t], len(of[t]), kept, sha(t)))
    return sorted(out, key=repr)


ODD = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (2, "a"), (None, "b"), (None, "b"), (7, "a "), (8, "é"), (9, "é"), (None, "a"), (10, "long " * 50_000), (11, "long " * 50_000), (12, "c")]


@pytest.mark.parametrize("digest", [lambda h: h, lambda h: F.substring(h, 1, 1), lambda h: F.lit("")], ids=["sha", "weak", "one"])
def test_groups_equal_brute_force(spark, digest):
    """Whatever the digest is, contents decide."""
    rng = random.Random(2)
    rows = ODD + [(100 + i, f"t{rng.randrange(40)}") for i in range(300)] + [(1000 + i, "hot") for i in range(200)] + [(None, "cold")] * 60
    df = spark.createDataFrame(rows, TEXTS).repartition(6)
    assert sorted(map(tuple, exact.groups(df, digest=digest).collect()), key=repr) == brute_groups(rows)


def test_rows_that_stay(spark):
    rows = [(i, t, k) for k, (i, t) in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `T` int").repartition(4).withColumn("d", F.lit(1)).withColumn("row.x", F.lit(2))
    got = exact.deduplicated(df)
    assert got.columns == df.columns
    want = {(k, i) for k, i in ((t or "", i) for i, t in ODD)}
    kept = [(r.text or "", r.doc_id) for r in got.collect()]
    assert len(kept) == len({t or "" for _, t in ODD}) and set(kept) <= want
    assert all(i == max((j or 0 for j, u in ODD if (u or "") == t)) for t, i in kept if i is not None)
    lower = exact.deduplicated(df, normalise=F.lower)
    assert {r.doc_id for r in lower.collect() if r.text in ("a", "A")} == {3}


def test_groups_of_an_empty_table(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert exact.groups(empty).collect() == [] and exact.deduplicated(empty).collect() == []


# ---- 13 periodic runs


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        x = 0
        while x + q < n:
            s = x
            while x + q < n and w[x] == w[x + q]:
                x += 1
            length = x - s + q
            if length >= max(least, exponent * q) and not any(w[s : s + length - p] == w[s + p : s + length] for p in range(1, q)):
                out.add((s, length, q))
            x += x == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_repeated(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def brute_row(i, text):
    w = brute_repeated(i, text)
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5), st.integers(4, 6))
def test_runs_equal_brute_force(texts, exponent):
    number = np.array([x for w in texts for x in w], dtype=np.int64)
    first = np.cumsum([0, *map(len, texts)])
    got = [tuple(r) for r in runs.runs(number, first, 4, exponent).tolist()]
    assert got == [(k, *r) for k, w in enumerate(texts) for r in brute_runs(w, 4, exponent)]


def test_longer_runs_equal_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            n, k = rng.randrange(1, 400), rng.choice([2, 5, 50])
            w = [rng.randrange(k) for _ in range(n)]
            a, p = rng.randrange(n), rng.randrange(1, 40)
            texts.append([w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)])
        number = np.array([x for w in texts for x in w], dtype=np.int64)
        got = [tuple(r) for r in runs.runs(number, np.cumsum([0, *map(len, texts)])).tolist()]
        assert got == [(k, *r) for k, w in enumerate(texts) for r in brute_runs(w)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200))
def test_next_smaller(values):
    got = runs.next_smaller(np.array(values))
    assert got.tolist() == [next((j for j in range(i + 1, len(values)) if values[j] < v), len(values)) for i, v in enumerate(values)]


def test_words_are_numbered_exactly():
    texts = ["a b a", None, "", " \t\x0b\x0c\r\na a b", "　", "x" * 9]
    raw, offsets = runs.string_buffers(pa.array(texts))
    number, start, size, first = runs.numbered(raw, offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [x for w in want for x in w]
    assert np.diff(first).tolist() == [len(w) for w in want]
    assert [raw[s : s + n].tobytes().decode() for s, n in zip(start.tolist(), size.tolist(), strict=True)] == flat
    assert len(set(number.tolist())) == len(set(flat)) == len(set(zip(number.tolist(), flat, strict=True)))


def run_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000 + i, "\n".join(rng.choice(["one two", "three", "four five six"]) for _ in range(80))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \t "), (2003, "go " * 30_000), (2003, "go " * 7), (None, "x y " * 9), (None, None), (2004, "été  été " * 4)]
    return rows + rows[:20]


def test_run_query_equals_brute_force(spark, tmp_path):
    rows = run_rows()
    spark.createDataFrame(rows, TEXTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    # the plain version can't take 30,000 words; a run of one word over all of them is known
    short = [r for r in rows if len(r[1] or "") < 50_000]
    found = Counter(map(tuple, got.collect()))
    assert not Counter(brute_row(*r) for r in short) - found and sum(found.values()) == len(rows)
    assert (2003, 1, 0, 30_000, 1, 30_000_000, sha("0,30000,1\n"), sha("go")) in found


@with_data
def test_run_query_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    found = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert rows and all(found[i] == brute_row(i, t) for i, t in rows)


def test_runs_of_an_empty_table_and_other_columns(spark):
    assert runs.with_runs(spark.createDataFrame([], TEXTS)).collect() == []
    df = spark.createDataFrame([(1, "a b " * 4, 5)], "doc_id long, text string, found int").withColumn("runs", F.lit("r"))
    got = runs.with_runs(df).first()
    assert got.runs == "r" and got.found.n_words == 8 and [tuple(r) for r in got.found.runs] == [(0, 8, 2)] and got.found.collapsed == "a b"
