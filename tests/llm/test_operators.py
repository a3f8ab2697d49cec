"""The ten operators against brute force, and their defined cases."""

import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import ann, chat, components, decontaminate, labels, licenses, mixing, neardup, quality, queries, secrets, textops, tokens, toxicity

WORD = re.compile(licenses.WORD)
SF = "/root/testdata/sf0.01"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SHORT = "doc_id long, text string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ---- text primitives


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1é É-\n€", max_size=30), min_size=1, max_size=6))
def test_words_and_shingles(texts):
    raw, offsets = textops.string_buffers(pa.array(texts))
    w = textops.Words(raw, offsets)
    want = [WORD.findall(re.sub("É", "é", t).lower() if True else t) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    assert len(set(w.hash.tolist())) == len(set(flat))
    where, value, _ = textops.shingles(w)
    expected = [(k, tuple(t[i : i + 5])) for k, t in enumerate(want) for i in range(max(1, len(t) - 4)) if t]
    assert where.tolist() == [k for k, _ in expected]
    assert len(set(value.tolist())) == len({s for _, s in expected})
    doc, _, count = textops.weighted_shingles(w)
    assert count.sum() == len(expected) and len(doc) == len(set(expected))


def test_slices_follow_bytes_and_sliced_arrays():
    column = pa.array(["x" * 10, None, "", "y y " * 1000, "z"] * 3)[2:]
    raw, offsets = textops.string_buffers(column)
    got = list(textops.slices(offsets, 100))
    assert got[0][0] == 0 and got[-1][1] == len(column) and all(a < e for a, e in got)
    assert [e for _, e in got][:-1] == [a for a, _ in got][1:]


# ---- 1 decontamination


def brute_leaks(docs, items, threshold=0.8):
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        w, v = words(text), words(item)
        if len(v) < 5 or not w:
            continue
        size = min(len(v), len(w))
        shingle = lambda x: [tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))]
        from collections import Counter

        b = Counter(shingle(v))
        for s in range(len(w) - size + 1):
            a = Counter(shingle(w[s : s + size]))
            if sum((a & b).values()) >= threshold * sum((a | b).values()):
                out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, rng.randrange(3, 40))) for k in range(40)]
    rows = []
    for d in range(60):
        body = prose(rng, rng.randrange(0, 120)).split()
        if d % 2:
            leak = items[rng.randrange(40)][1].split()
            if d % 3 == 0 and len(leak) > 20:
                leak[rng.choice([0, 1, -1])] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = leak
        rows.append((d, " ".join(body)))
    frames = spark.createDataFrame(rows, SHORT), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    for options in ({}, {"in_block": 7}):
        got = decontaminate.leaks(*frames, **options).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.similarity >= 0.8 for r in got)


def test_decontamination_finds_all_at_the_threshold(monkeypatch):
    """Windows near 0.8 whose fingerprints differ in more bits than the tables reach."""
    monkeypatch.setattr(decontaminate, "RADIUS", 9)
    rng = random.Random(21)
    items, texts, far = [], [], 0
    for k in range(400):
        item = [f"v{k}x{j}" for j in range(rng.randrange(60, 200))]
        # the last words replaced, as far as Jaccard stays at 0.8
        changed = (len(item) - 4) // 9
        leak = item[:-changed] + [f"other{k}x{j}" for j in range(changed)]
        items.append(" ".join(item))
        texts.append(f"before {' '.join(leak)} after")
    index = decontaminate.ItemIndex(list(range(400)), items, exact=True)
    found = index.matches(pa.array(texts))
    leaks = decontaminate.ItemIndex(list(range(400)), [t.removeprefix("before ").removesuffix(" after") for t in texts])
    far = int((np.bitwise_count(leaks.prints ^ index.prints) > decontaminate.RADIUS).sum())
    assert [[m[0] for m in row] for row in found] == [[k] for k in range(400)] and far > 0


def test_fingerprints_propose(monkeypatch):
    """Without the fingerprints' tables nothing is found, and with them 0.99 of what is near the threshold."""
    rng = random.Random(22)
    items, texts = [], []
    for k in range(1000):
        item = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(15, 200))]
        for share in (9, 12, 20):
            changed = (len(item) - 4) // share
            texts.append(" ".join(["before", *item[: len(item) - changed], *(f"other{k}x{j}" for j in range(changed)), "after"]))
        items.append(" ".join(item))
    exact, index = (decontaminate.ItemIndex(list(range(1000)), items, exact=e) for e in (True, False))
    count = lambda i: sum(map(len, i.matches(pa.array(texts))))
    want = count(exact)
    assert want >= 3000 and 0.99 * want <= count(index) <= want
    monkeypatch.setattr(decontaminate.ItemIndex, "near", lambda self, prints: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert count(index) == 0 and count(exact) == want


def test_blocks_of_items_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BYTES_IN_BLOCK", 200)
    item = "one two three four five six seven eight"
    items = spark.createDataFrame([(k, f"{item} v{k} w{k} x{k} y{k} z{k}") for k in range(20)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), "text")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(k, k) for k in range(20)]


def test_decontamination_cases(spark):
    item = "one two three four five six seven eight"
    rows = [(1, None, "x"), (2, "", "x"), (3, f"{item} and {item}", "x"), (3, item.upper(), "y"), (None, item, "z"), (5, "one two three four five six seven", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "one two"), (7, item)], "item_id long, text string")
    got = decontaminate.with_matches(docs, items).select("doc_id", "item_id", F.size("matches").alias("n")).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n) for r in got) == [("1", "x", 0), ("2", "x", 0), ("3", "x", 2), ("3", "y", 2), ("5", "x", 0), ("None", "z", 2)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs.drop("item_id"), none).count() == 0
    assert decontaminate.leaks(docs.limit(0).drop("item_id"), items).count() == 0


def test_decontamination_of_short_and_nameless_items(spark, tmp_path):
    import corpus_pipeline

    long = "one two three four five six seven eight"
    rows = [(1, "Say: yes, we can."), (2, "two one"), (3, f"{long} two, three"), (4, "can"), (5, ""), (6, None)]
    spark.createDataFrame(rows, SHORT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "yes we can"), (8, "Two three"), (None, long), (9, "..."), (None, "can"), (8, "two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op1_decontamination(spark, str(tmp_path)).collect()
    want = [(1, 7, 1, 4), (1, None, 3, 4), (3, 8, 1, 3), (3, 8, 1, 3), (3, None, 0, 8), (4, None, 0, 1)]
    assert sorted(map(str, ((r.doc_id, r.item_id, r.start_word, r.end_word) for r in got))) == sorted(map(str, want))
    kept = corpus_pipeline.decontamination_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 5, 6]


def test_hamming_tables_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    texts = [prose(random.Random(k), 12, 60) for k in range(300)]
    index = decontaminate.ItemIndex(list(range(300)), texts)
    probes = index.prints[:50] ^ np.array([sum(1 << int(b) for b in rng.choice(64, size=k % 20, replace=False)) for k in range(50)], dtype=np.uint64)
    q, item = index.near(probes)
    want = {(a, b) for a in range(50) for b in range(300) if bin(int(probes[a]) ^ int(index.prints[b])).count("1") <= decontaminate.RADIUS}
    assert set(zip(q.tolist(), item.tolist(), strict=True)) == want


# ---- 2 licenses


def test_licenses_cases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, "The MIT License. mit license MIT-License"), (2, None), (3, ""), (4, mit), (5, "permission hereby granted to any person"),
        (6, "Licensed under the Apache License, Version 2.0."), (7, "GNU General Public License general public license apache license"), (8, "mit licenses"), (9, "x " * 9000 + "mit license"), (1, "The MIT License. mit license MIT-License"),
    ]
    got = licenses.with_licenses(spark.createDataFrame(rows, SHORT).withColumn("score", F.lit("clash"))).orderBy("doc_id").collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels, by[1].labels) == (7, 3, 1, 5, "mit", "mit")
    for k in (2, 3):
        assert (by[k].n_words, by[k].n_base, by[k].first_word, by[k].labels, by[k].score) == (0, 0, None, "", 0.0)
    assert by[4].labels == "mit" and by[4].n_base == 0 and by[5].labels == ""
    assert by[6].labels == "apache,apache-2.0" and by[7].base_labels == "apache,gpl" and by[7].n_base == 3
    assert by[8].n_base == 0 and by[9].last_word == 9000 and len(got) == 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("mit license apache general public the x".split()), max_size=14))
def test_anchors_lose_nothing(sequence):
    index = licenses.Index()
    places = lambda phrase: [k for k in range(len(sequence)) if sequence[k : k + len(phrase)] == phrase]
    if any(places(p.split()) for p, _ in licenses.BASE):
        assert set(sequence) & set(index.anchors)


# ---- 3 toxicity and 10 quality


@with_data
@pytest.mark.parametrize("module, label, threshold", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_accuracy(docs, marks, module, label, threshold):
    model = module.train(docs, marks)
    got = module.score(docs.select("doc_id", "text"), model).join(marks, "doc_id").filter(labels.held_out(F.col("doc_id"))).select("score", label).collect()
    right = sum((r.score >= threshold) == (r[label] == 1) for r in got)
    assert len(got) > 50 and right / len(got) > 0.95


def test_held_out_fold(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 7, 12345)] + [(None,)], "doc_id long")
    got = rows.select("doc_id", labels.fold(F.col("doc_id")).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 for r in got]


def test_training_rows_are_bounded_and_outside_the_fold(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)], SHORT)
    marks = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = labels.training_rows(docs, marks, "quality", 50).collect()
    assert len(got) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels_and_with_odd_texts(spark, module, label):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "\n\n", 3.0), (4, "word " * 50_000, 4.0), (4, "word", 5.0), (None, "…!?", 6.0)], "doc_id long, text string, score_ double")
    for rows in ([], [(3, 1)], [(k, k % 2) for k in range(1, 5)]):
        marks = spark.createDataFrame(rows, f"doc_id long, {label} int")
        got = module.score(docs, module.train(docs, marks)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert module.score(docs.limit(0), module.train(docs, marks)).count() == 0


def test_folding_and_exceptions():
    assert toxicity.folded("1D10T, sсum m​oron $tupid st@pid") == " idiot scum moron tupid stapid "
    lexicon = toxicity.Lexicon({" scum ": 2.0, " idio": 1.0, " idiot ": 3.0})
    a = lexicon.automaton()
    assert lexicon.measures("An IDIOT and pond scum, scum", a) == (2, 5.0, 500 / 6, 3.0)
    assert lexicon.measures(None, a) == (0, 0.0, 0.0, 0.0) and toxicity.Lexicon(exceptions=()).measures("x", toxicity.Lexicon(exceptions=()).automaton())[0] == 0


def test_flattened_trees_equal_plain_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, trees=15, depth=3)
    binned = model.bins(x)
    want = []
    for row in binned:
        total = model.base
        for f, b, leaf in zip(model.feature, model.below, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > b[node])
            total += leaf[node - len(f)]
        want.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.score(x), want) and ((model.score(x) > 0.5) == y).mean() > 0.95


# ---- 4 mixing


def test_mixing_rates_and_determinism(spark):
    rows = [(k, "t", "big" if k % 10 else "small") for k in range(4000)] + [(-k, "t", None) for k in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (mixing.mix(d, {"big": 1.0, "small": 2.0, None: 1.0}, total=6000) for d in (docs, docs.repartition(7)))
    a, b = (sorted((r.doc_id, r.copy) for r in d.collect()) for d in (one, two))
    assert a == b
    n = {r.source: r["count"] for r in one.groupBy("source").count().collect()}
    assert abs(n["big"] - 1500) < 200 and abs(n["small"] - 3000) < 300 and abs(n[None] - 1500) < 200
    copies = {}
    for d, c in a:
        copies.setdefault(d, []).append(c)
    assert all(v == list(range(len(v))) for v in copies.values())
    small = [len(copies.get(k, [])) for k in range(0, 4000, 10)]
    assert abs(np.mean(small) - 7.5) < 0.6 and abs(np.var(small) - 7.5) < 2  # Poisson


def test_mixing_cases(spark):
    docs = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, "b", 4)], "doc_id long, source string, copy int")
    got = mixing.mix(docs).collect()
    assert all(0 <= r.copy for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, {"zzz": 1.0}).count() == 0


@pytest.mark.parametrize("text", ["'one text'", "concat('t', id)"], ids=["equal", "unlike"])
def test_rows_without_an_id_or_of_one_id_draw_one_by_one(spark, monkeypatch, text):
    """At rate 1, about 1 - 1/e of the rows are drawn, and about as many copies come out as there are rows."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    named = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text", "'s' AS source")
    for i in ("CAST(NULL AS BIGINT)", "7000L"):
        docs = named.unionByName(spark.range(1000).selectExpr(f"{i} AS doc_id", f"{text} AS text", "'s' AS source"))
        got = mixing.mix(docs).filter("doc_id IS NULL OR doc_id = 7000")
        assert 850 < got.count() < 1150 and 560 < got.filter("copy = 0").count() < 710
        # the global shuffle deals them out
        dealt = [len(p) for p in mixing.mix(docs).rdd.glom().collect()]
        assert max(dealt) < 3 * sum(dealt) / len(dealt)


def test_inversion_is_the_poisson_distribution(spark):
    import math

    cdf = spark.range(1).select(mixing.cumulative(F.lit(3.5)).alias("c")).first().c
    want = np.cumsum([math.exp(-3.5) * 3.5**k / math.factorial(k) for k in range(mixing.TERMS)])
    assert np.allclose(cdf, want)


# ---- 5 chat


def test_chat_equals_brute_force(spark):
    rng = random.Random(5)
    convs = {}
    for c in range(120):
        convs[c] = [(rng.choice("us"), rng.choice("ab")) for _ in range(rng.randrange(1, 6))]
    rows = [(c, 3 * k - 1, r, t, "extra") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    kept = {}
    for c, turns in sorted(convs.items()):
        if not any(o != c and p[: len(turns)] == turns and (len(p) > len(turns) or o < c) for o, p in convs.items()):
            kept[c] = "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)
    got = chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")).collect()
    assert {r.conv_id: r.text for r in got} == kept


def test_chat_runs_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 4)
    rows = [(1, k, "u", f"t{k}") for k in range(11)] + [(2, k, "u", f"t{k}") for k in range(9)] + [(3, 0, None, None), (None, 0, "u", "lone"), (None, None, "u", "first"), (4, 0, "unknown", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = sorted((str(r.conv_id), r.part, r.turns, r.n, r.text) for r in chat.rendered(df).collect())
    assert [p[:4] for p in parts] == [("1", 0, 11, 4), ("1", 1, 11, 4), ("1", 2, 11, 3), ("3", 0, 1, 1), ("4", 0, 1, 1), ("None", 0, 2, 2)]
    assert "".join(p[4] for p in parts if p[0] == "1").count("<|end|>") == 11
    assert parts[-1][4].index("first") < parts[-1][4].index("lone") and parts[3][4] == "<|unknown|>\n\n<|end|>\n"
    assert chat.rendered(df.limit(0)).count() == 0


# ---- 6 near-duplicates


def brute_classes(rows, threshold=0.8):
    sets = list(neardup._sets(pa.array([t for _, t in rows], type=pa.string())))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if neardup.probability_jaccard(*sets[a], *sets[b]) >= threshold:
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, (d, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    passage = prose(rng, 60)
    for g in range(25):
        base = prose(rng, rng.randrange(30, 120)).split()
        if g % 3 == 0:
            base += passage.split()
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    # A chain: neighbours are near, ends are not.
    chain = prose(rng, 200).split()
    for k in range(12):
        rows.append((len(rows), " ".join(chain[6 * k : 6 * k + 130])))
    got = neardup.classes(spark.createDataFrame(rows, SHORT)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows) and len(got) == len(rows)


def test_near_duplicate_cases(spark):
    rows = [(5, "same words here"), (3, "Same, words HERE!"), (7, None), (8, ""), (9, "..."), (1, "other text " * 20_000), (3, "Same, words HERE!"), (None, "same words here"), (None, "lone words"), (2, "x")]
    docs = spark.createDataFrame(rows, SHORT).withColumn("class_id", F.lit("clash"))
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(docs).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("7", "7"), ("8", "8"), ("9", "9"), ("1", "1"), ("3", "3"), ("None", "3"), ("None", "None"), ("2", "2")])
    kept = sorted(str(r.doc_id) for r in neardup.keepers(docs).collect())
    assert kept == ["1", "2", "3", "7", "8", "9", "None", "None"]
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.keepers(docs.limit(0)).count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    near = lambda t: t.replace(t.split()[-1], "changed") if t.count(t.split()[-1]) == 1 else t + " changed"
    # Id 7 has a text near that of 3, one near that of 9, and one of its own; d is near among rows without ids only.
    rows = [(3, a), (7, near(a)), (7, b), (9, near(b)), (7, c), (None, d), (None, near(d)), (None, near(c))]
    docs = spark.createDataFrame(rows, SHORT)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(docs).collect())
    assert got == sorted([("3", "3"), ("7", "3"), ("7", "7"), ("9", "7"), ("7", "7"), ("None", "None"), ("None", "None"), ("None", "7")])
    kept = sorted((str(r.doc_id), r.text) for r in neardup.keepers(docs).collect())
    assert kept == sorted([("3", a), ("7", b), ("7", c), ("None", min(d, near(d))), ("None", near(c))])


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    for shared, own in ((40, 10), (20, 20), (5, 45)):
        e = rng.integers(1, 2**47, size=shared + 2 * own).astype(np.uint64)
        a, b = np.sort(e[: shared + own]), np.sort(np.concatenate([e[:shared], e[shared + own :]]))
        wa, wb = rng.integers(1, 4, len(a)).astype(float), rng.integers(1, 4, len(b)).astype(float)
        doc, element = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
        s = neardup.signatures(doc, element, np.concatenate([wa, wb]), 2, size=4000)
        assert abs((s[0] == s[1]).mean() - neardup.probability_jaccard(a, wa, b, wb)) < 0.04
    assert (neardup.signatures(np.array([1]), np.array([9], np.uint64), np.ones(1), 3)[[0, 2]] == 0).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 199)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7 nearest neighbours


def brute_neighbours(rows, queries, k=5):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            ranked = sorted((-float(u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v))), i) for i, u in good if i != q)
            out[q] = [i for _, i in ranked[:k]]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.normal(size=16).astype(np.float32).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, df.filter("vec_id % 20 = 0"), shard_nodes=300, query_block=20).collect()
    want = brute_neighbours(rows, set(range(0, 900, 20)))
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
        a, b = (np.array(rows[i][1], dtype=float) for i in (r.query_id, r.vec_id))
        assert abs(r.score - a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))) < 1e-12
    assert all(len(v) == 5 for v in found.values()) and set(found) == set(want)
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.95


def test_neighbour_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (9, [1.0]), (10, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(k, [1.0, 0.0]) for k in range(20, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in sorted(ann.neighbours(df, df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 20, 21] and got[2] == [0, 1, 3, 20, 21] and got[59] == [0, 1, 2, 3, 20]
    assert got[3] == [0, 1, 2, 20, 21] and set(got) == {0, 1, 2, 3, 8, *range(20, 60)}
    two = spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(two, two).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]
    assert ann.neighbours(two.limit(0), two).count() == 0 and ann.neighbours(two, two.limit(0)).count() == 0


def test_neighbours_of_ids_with_many_vectors(spark):
    """Ids 1 and 0 have many vectors nearer to the query than any of the others; each id is one candidate."""
    at = lambda angle: [float(np.cos(angle)), float(np.sin(angle))]
    rows = [(0, at(0.0))] + [(0, at(0.0001 * k)) for k in range(1, 150)] + [(1, at(0.1 + 0.0001 * k)) for k in range(150)] + [(k, at(0.2 * k)) for k in range(2, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, df.limit(1)).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert abs(got[0].score - np.cos(0.1)) < 1e-12


# ---- 8 token counts


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_token_counts_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 3)
    texts = [(1, None), (2, ""), (3, "hello <|endoftext|> world " * 400), (4, "é€😀"), (4, "é€😀"), (None, "a b c")] + [(10 + k, f"word{k} " * (k % 9)) for k in range(60)]
    docs = spark.createDataFrame(texts, SHORT).repartition(3)
    model = tokens.tokenizer(tokens.VOCABULARY)
    want = sorted((str(i), len(model.encode_ordinary(t or ""))) for i, t in texts)
    for size in (5, 1000, 1 << 16):
        got = tokens.counts(docs, block_tokens=size).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert tokens.counts(docs.limit(0)).count() == 0
    for options in ({"separator": 17}, {"separator": 70_000}):
        with pytest.raises(ValueError):
            tokens.counts(docs, **options)


@pytest.mark.parametrize("by_workers", [True, False])
def test_flat_files(spark, tmp_path, monkeypatch, by_workers):
    monkeypatch.setattr(tokens, "RANGE", 3)
    monkeypatch.setattr(tokens, "workers_can_open", lambda path: by_workers)
    rng = np.random.default_rng(7)
    files = {"a": [3, 0, 5000, 1], "b": [0], "c": []}
    for name, sizes in files.items():
        flat = [x for n in sizes for x in [*rng.integers(0, 99, n), 7777]]
        np.array([*flat, *([5, 5] if name == "a" else [])], dtype="<u2").tofile(tmp_path / f"{name}.bin")
    got = tokens.scan(tokens.read_flat(spark, str(tmp_path / "*.bin"), block_tokens=64), separator=7777).collect()
    by = sorted((os.path.basename(r.file)[0], r.ordinal, r.n_tokens, r.ended) for r in got)
    assert by == [("a", 0, 3, True), ("a", 1, 0, True), ("a", 2, 5000, True), ("a", 3, 1, True), ("a", 4, 2, False), ("b", 0, 0, True)]


def test_a_flat_file_of_any_length_is_dealt_in_ranges(spark, tmp_path):
    """5 GB, of which nothing is stored: more than Spark's own reader takes."""
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate(5 << 30)
    got = tokens.ranges(spark, str(tmp_path / "huge.bin")).collect()
    step = tokens.RANGE * tokens.BLOCK_TOKENS * tokens.WIDTH
    assert sorted((r.start, r.end) for r in got) == [(k, min(k + step, 5 << 30)) for k in range(0, 5 << 30, step)]
    one = tokens.read_flat(spark, str(tmp_path / "huge.bin")).filter("block = 40000").select("block", F.length("data").alias("n"), F.md5("data").alias("h"))
    assert len(got) == 160 and "ReadSchema: struct<path:string,length:bigint>" in one._jdf.queryExecution().toString()


# ---- 9 secrets


def brute_spans(text):
    found = []
    for place, rule in enumerate(secrets.RULES):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        for m in re.finditer(pattern, text or ""):
            if len(m[rule.group]) >= (32 if rule.kind == "hex" else rule.least):
                found.append((m.start(), place, m.end(), rule.kind))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(9)
    bits = ['token="', "password: ", "api_key=", "APIKEY = '", "secret:", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "abcdefgh", "é😀", " ", "=", "ghp_" + "a1" * 20, "://", "http", "user:pw@", "\n", "eyJ", "-----BEGIN RSA PRIVATE KEY-----", "short"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "token=abcdefgh " * 700), (902, "token=abcdefgh " * 700)]
    df = spark.createDataFrame(rows, SHORT).withColumn("spans", F.lit("clash"))
    got = secrets.with_spans(df).select("doc_id", "text", secrets.joined(F.col("spans")).alias("s")).collect()
    assert [r.s for r in got] == [brute_spans(r.text) for r in got] and len(got) == len(rows)
    for r in secrets.redacted(df).join(df.select("doc_id", F.col("text").alias("old")), "doc_id").limit(200).collect():
        assert brute_spans(r.text) == "" or "[SECRET]" in r.text


def test_trigram_queries_lose_nothing_and_postings_agree(spark):
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is None
    assert secrets.trigram_query(r"abcd") == ("and", ("abc", "bcd"))
    kind, parts = secrets.trigram_query(r"(foo|bar)x*")
    assert kind == "or" and {p[1] for p in parts} == {("foo",), ("bar",)}
    assert secrets.trigram_query(r"a?b") is None
    docs = spark.createDataFrame([(1, "Token AKIA"), (2, None)], SHORT)
    rows = {(r.trigram, r.doc_id) for r in secrets.postings(docs).collect()}
    assert {("aki", 1), ("kia", 1), ("tok", 1)} <= rows and all(d == 1 for _, d in rows)
    index = {r.doc_id: set(r.trigrams) for r in secrets.indexed(docs).collect()}
    assert index[1] == {g for g, _ in rows} and index[2] == set()


# ---- queries against their SQL


@with_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    order = [want.columns.index(c) for c in columns]
    assert plain(map(tuple, got.select(*columns).collect())) == plain(tuple(r[k] for k in order) for r in want.fetchall())


def test_digest_of_an_empty_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


# ---- 3 toxicity and 10 quality against plain Python


def test_automaton_equals_plain_search():
    """Hits, weights and exceptions by looking every entry up at every place."""
    rng = random.Random(31)
    entries = {" scum ": 2.0, " idio": 1.0, " idiot ": 3.0, " trash ": 1.5, " tr": 0.5, " sc": 0.25, " can ": 0.75}
    lexicon = toxicity.Lexicon(entries)
    automaton = lexicon.automaton()
    bits = ["idiot", "1d10t", "IDIOTIC", "scum", "$cum", "pond scum", "trash can", "trash", "cans", "can", "tree", "ѕcum", "a​b", "—", "!!"]
    for _ in range(400):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        t = toxicity.folded(text)
        spared = [(k, k + len(p)) for p in map(toxicity.folded, toxicity.EXCEPTIONS) for k in range(len(t)) if t.startswith(p, k)]
        hits = {}
        for at in range(len(t)):
            found = [w for e, w in entries.items() if t.startswith(e, at)]
            if found and not any(a <= at < e - 1 for a, e in spared):
                hits[at] = max(found)
        total, words_ = sum(hits.values()), max(1, len(t.split()))
        got = lexicon.measures(text, automaton)
        assert got[0] == len(hits) and np.allclose(got[1:], (total, 100 * total / words_, max(hits.values(), default=0.0))), text


def plain_statistics(text):
    t = text or ""
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), t)
    data = t.encode()
    w = [x.encode() for x in words(t)]
    starts = [m.start() for m in WORD.finditer(low)]
    lines = t.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    share = lambda chars: sum(b in chars for b in data) / max(1, len(data))
    n = max(1, len(w))
    size = [len(x) for x in w]
    mean = sum(size) / n
    grams = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    per_line = [tuple(words(x)) for x in lines]
    out = {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(w)), **{k: share(v) for k, v in quality._GROUPS.items()},
        "control": sum(b < 128 and not any(b in v for v in quality._GROUPS.values()) for b in data) / max(1, len(data)), "non_ascii": sum(b >= 128 for b in data) / max(1, len(data)),
        "word_bytes": mean, "word_spread": np.sqrt(max(0, sum(x * x for x in size) / n - mean * mean)), "long_words": sum(x >= 12 for x in size) / n, "tiny_words": sum(x <= 1 for x in size) / n,
        "distinct_words": len(set(w)) / n, "top_word": max([w.count(x) for x in set(w)], default=0) / n, "distinct_shingles": len(set(grams)) / max(1, len(grams)),
        "log_lines": np.log1p(len(lines)), "line_bytes": len(data) / max(1, len(lines)), "repeated_lines": (len(lines) - len(set(per_line))) / max(1, len(lines)),
        "lines_ended": sum(x[-1:] in (".", "!", "?") for x in lines) / max(1, len(lines)), "capital_words": sum("A" <= t[k] <= "Z" for k in starts) / n,
    }
    return [out[k] for k in quality.FEATURES]


def test_statistics_equal_plain_python():
    rng = random.Random(32)
    bits = ["Word", "a", "exceedingly-long", "internationalisation", "7", "é", "日本", ".", "!", "? ", "\n", "\n\n", "(x)", "$5", "\t", "#", "same line.\n", "same line.\n", "\x01", "~"]
    texts = [None, "", "\n", " ", "...", "One.\nOne.\n"] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    got = quality.statistics(pa.array(texts, type=pa.string()))
    for k, text in enumerate(texts):
        want = plain_statistics(text)
        for name, a, b in zip(quality.FEATURES, got[k], want, strict=True):
            assert abs(a - b) < 1e-4 * max(1, abs(b)), (name, a, b, text)


def test_histogram_fit_takes_the_best_split():
    """One tree of depth 1 against trying every threshold of every statistic."""
    rng = np.random.default_rng(33)
    x = rng.integers(0, 12, size=(300, 4)).astype(np.float32)
    y = (x[:, 2] + rng.normal(size=300) > 6).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, rate=1.0, l2=2.0)
    p = y.mean()
    grad, hess = p - y, np.full(300, p * (1 - p))
    best = max(((f, e) for f in range(4) for e in model.edges[f]), key=lambda fe: sum(grad[m].sum() ** 2 / (hess[m].sum() + 2.0) for m in (x[:, fe[0]] <= fe[1], x[:, fe[0]] > fe[1]) if hess[m].sum() >= 2))
    assert model.feature[0, 0] == best[0]
    left = x[:, best[0]] <= best[1]
    want = np.where(left, -grad[left].sum() / (hess[left].sum() + 2.0), -grad[~left].sum() / (hess[~left].sum() + 2.0))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.base + want))))


def test_training_rows_of_repeated_ids_are_the_same_each_time(spark):
    docs = spark.createDataFrame([(3, f"text {k % 50}") for k in range(400)] + [(k, "x") for k in range(10, 60)], SHORT)
    marks = spark.createDataFrame([(3, 1)] + [(k, 0) for k in range(10, 60)], "doc_id long, quality int")
    rows = lambda d: sorted((r.doc_id, r.text) for r in labels.training_rows(d, marks, "quality", 30).collect())
    one = rows(docs)
    assert one == rows(docs.repartition(7)) and 0 < len(one) <= 30 and len(set(one)) == len(one)


def test_decontamination_in_passes_equals_one_pass(spark):
    """Repeated items and texts, null ids, and a clashing column, over several blocks."""
    rng = random.Random(41)
    items = [(k % 17 if k % 5 else None, prose(rng, rng.randrange(1, 30))) for k in range(30)]
    items += items[:6]
    rows = [(d, " ".join([prose(rng, 20), rng.choice(items)[1], prose(rng, 5), rng.choice(items)[1]]), "old") for d in range(25)]
    rows += rows[:5] + [(77, None, "old"), (78, "", "old")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, matches string"), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda df: sorted((str(r.doc_id), str(r.text), sorted(map(str, r.matches))) for r in df.collect())
    one = plain(decontaminate.with_matches(docs, bench, least_words=1))
    assert one == plain(decontaminate.with_matches(docs, bench, least_words=1, in_block=7)) and any(m for _, _, m in one)
