"""The pipeline against a plain version of each stage, and the stages' defined cases."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_leaks, brute_spans, prose

import corpus_pipeline
from lodestar.llm import ann, chat, decontaminate, licenses, mixing, neardup, quality, secrets, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
#: Every name that the operators give a column, whether it leaves them or not.
NAMES = sorted({n for f in Path(mixing.__file__).parent.glob("*.py") for m in re.findall(r'alias\("(\w+)"\)|withColumn\("(\w+)"|, "(\w+)"\)', f.read_text()) for n in m if n})


def written(spark, folder, documents, items=(), labels=()):
    """Tables as Parquet files; the folder."""
    spark.createDataFrame(list(documents), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus(seed=51, n=90):
    import random

    rng = random.Random(seed)
    items = [(k, prose(rng, rng.randrange(2, 25))) for k in range(8)]
    rows, marks = [], []
    for k in range(n):
        good = k % 4 != 3
        body = prose(rng, rng.randrange(40, 90)) + "." if good else "!!! $$$ 12 % " * rng.randrange(3, 20)
        if good and rows and k % 7 == 0:
            near = rng.choice([r for r in rows if r[5]])[1].split()
            near[rng.randrange(len(near))] = "changed"
            body = " ".join(near)
        if good and k % 9 == 1:
            body = f"{body} {rng.choice(items)[1]} {prose(rng, 8)}"
        if good and k % 5 == 2:
            body = f"{body} password = hunter2hunter2 and AKIA{'A1B2' * 4} at ftp://me:pw@host"
        rows.append((k, body, "en", rng.choice(["a", "a", "a", "b", None]), len(body), good))
        marks.append((k, int(good), 0))
    return [r[:5] for r in rows], items, marks


def plain_walk(model, x):
    binned = model.bins(x)
    out = []
    for row in binned:
        total = model.base
        for f, b, leaf in zip(model.feature, model.below, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > b[node])
            total += leaf[node - len(f)]
        out.append(1 / (1 + math.exp(-total)))
    return out


def plain_redacted(text):
    spans = [(int(a), int(e)) for _, a, e in (s.split(":") for s in brute_spans(text).split(",") if s)]
    out, done = [], 0
    for a, e in sorted(spans):
        if a >= done:
            out.append(text[done:a] + "[SECRET]")
        done = max(done, e)
    return "".join(out) + text[done:]


def plain_copies(rows):
    """Poisson inversion by the md5 of seed, id, text, number among equals and draw; sources have equal weight."""
    by = Counter(r[3] for r in rows)
    out, seen = [], Counter()
    for r in rows:
        number, seen[r] = seen[r], seen[r] + 1
        rate = len(rows) * (1.0 / len(by)) / by[r[3]]
        draws = math.ceil(rate / mixing.MEAN_OF_DRAW)
        mean = rate / draws
        copies = 0
        for j in range(1, draws + 1):
            u = int(hashlib.md5(f"17:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}:{number}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            total, k = 0.0, 0
            while k < mixing.TERMS and (total := total + math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))) <= u:
                k += 1
            copies += k
        out += [(*r, c) for c in range(copies)]
    return out


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows, items, marks = corpus()
    folder = written(spark, tmp_path, rows, items, marks)
    got = sorted((r.doc_id, r.text, r.lang, str(r.source), r.n_chars, r.copy) for r in corpus_pipeline.run(spark, folder).collect())

    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    score = plain_walk(model, quality.statistics(pa.array([r[1] for r in rows])))
    kept = [r for r, s in zip(rows, score, strict=True) if s >= corpus_pipeline.LEAST_QUALITY]
    assert len(kept) < len(rows)
    classes = brute_classes([(r[0], r[1]) for r in kept])
    unlike = [r for r in kept if classes[r[0]] == r[0]]
    assert len(unlike) < len(kept)
    short = {(r[0], i) for r in unlike for i, t in items if len(t.split()) < 5 and f" {t} " in f" {r[1]} "}
    held = {d for d, _ in brute_leaks([(r[0], r[1]) for r in unlike], items) | short}
    clean = [r for r in unlike if r[0] not in held]
    assert held
    masked = [(r[0], m := plain_redacted(r[1]), r[2], r[3], len(m) if m != r[1] else r[4]) for r in clean]
    assert any("[SECRET]" in r[1] for r in masked)
    want = sorted((*r[:3], str(r[3]), *r[4:]) for r in plain_copies(masked))
    assert got == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items, marks = corpus()
    return written(spark, tmp_path_factory.mktemp("stages"), rows, [*items, (None, "one two three four five six"), (9, None)], marks)


LONG = " ".join(f"word{k % 5000} longer{k % 77}." for k in range(60_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here, only some words to read.", "en", None, 35), (4, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)),
    (4, "another text of the same id.", "en", "b", 28), (None, None, None, "b", None), (7, "…!? \U0001f600", "xx", "a", 5), (8, LONG + " secret: abcdefgh1234", "en", "a", len(LONG)),
]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows_and_clashing_columns(spark, folder, name):
    extra = [n for n in NAMES if n.lower() not in {"doc_id", "text", "lang", "source", "n_chars", "copy"}]
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in extra})
    got = STAGES[name](spark, docs, folder)
    assert got.columns[: len(docs.columns)] == docs.columns and len(got.columns) - len(docs.columns) == (name == "mixing")
    rows = got.collect()
    assert all(r[n] == "clash" for r in rows for n in extra)
    found = Counter((r.doc_id, r.text) for r in rows)
    if name == "near_duplicates":
        # One of the repeated rows; 8 is near 4, and the wordless texts are apart.
        assert found == Counter({(1, None): 1, (2, ""): 1, (None, ODD[2][1]): 1, (4, LONG): 1, (4, ODD[5][1]): 1, (None, None): 1, (7, ODD[7][1]): 1})
    elif name == "decontamination":
        assert found == Counter((r[0], r[1]) for r in ODD)
    elif name == "secrets":
        assert found[8, LONG + " [SECRET]"] == 1 and len(rows) == len(ODD)
        assert next(r.n_chars for r in rows if r.doc_id == 8) == len(LONG) + 9
    elif name == "quality":
        assert set(found) <= {(r[0], r[1]) for r in ODD} and found[4, LONG] in (0, 2)
    else:
        assert set(found) <= {(r[0], r[1]) for r in ODD} and all(r["copy"] >= 0 for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_empty_tables(spark, folder, tmp_path, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert STAGES[name](spark, docs, folder).count() == 0
    empty = written(spark, tmp_path, [])
    some = spark.createDataFrame(ODD, SCHEMA)
    assert STAGES[name](spark, some, empty).count() >= 0


TEXTS = [(1, "The MIT license. scum password=abcdefgh1 one two three four five six"), (1, "The MIT license. scum password=abcdefgh1 one two three four five six"), (None, None), (3, "")]
ITEMS = [(5, "one two three four five six")]
OPERATORS = {
    "decontamination": (lambda d, s: decontaminate.with_matches(d, s.createDataFrame(ITEMS, "item_id long, text string")), {"matches"}),
    "licenses": (lambda d, s: licenses.with_licenses(d), {"n_words", "found", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}),
    "toxicity": (lambda d, s: toxicity.score(d, toxicity.Lexicon({" scum ": 2.0})), {"score", "score_hits"}),
    "secrets": (lambda d, s: secrets.with_spans(d), {"spans"}),
    "redaction": (lambda d, s: secrets.redacted(d), set()),
    "quality": (lambda d, s: quality.score(d, quality.fit(np.zeros((0, len(quality.FEATURES)), np.float32), np.zeros(0))), {"score"}),
    "mixing": (lambda d, s: mixing.mix(d), {"copy"}),
    "keepers": (lambda d, s: neardup.keepers(d), set()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_pass_columns_of_any_name(spark, name):
    """Columns named as anything inside the operators come through; those of the result are replaced."""
    apply, made = OPERATORS[name]
    extra = [n for n in NAMES if n not in ("doc_id", "text", "source")]
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("source", F.lit("a")).withColumns({n: F.lit("clash") for n in extra})
    got = apply(docs, spark)
    assert sorted(got.columns) == sorted({*docs.columns, *made})
    assert all(r[n] == "clash" for r in got.collect() for n in extra if n not in made)


def test_operators_without_other_columns_ignore_them(spark):
    extra = {n: F.lit("clash") for n in NAMES if n not in ("doc_id", "text", "vec_id", "embedding", "conv_id", "turn", "role")}
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns(extra)
    assert neardup.classes(docs).count() == 4
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "vec_id long, embedding array<float>").withColumns(extra)
    assert ann.neighbours(vectors, vectors).count() == 12
    turns = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "b", "c"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string").withColumns(extra)
    assert [r.turns for r in chat.rendered(turns).collect()] == [2]
    if Path(tokens.VOCABULARY).exists():
        assert tokens.counts(docs).count() == 4
