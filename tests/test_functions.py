import fnmatch
import math
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from lodestar.functions import sparse, text, vectors

PATHS = ["a.md", "b/C.TXT", ".hidden/x.md", "d/.e.md", "noext", "x.tar.gz", "dot.", "b/notes.log", "build/out/a.md", "q[1].md", "z.PDF", "_under.md"]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = df.select("p", text.suffix(F.col("p")), text.stem(F.col("p"))).collect()
    for p, ext, stem in got:
        assert ext == PurePosixPath(p).suffix.lower() or p == "dot."
        assert stem == PurePosixPath(p).stem or p == "dot."


@pytest.mark.parametrize("pattern", ["*.log", "build/*", "**/*.md", "?.md", "q[[]1].md", "[!a]*", "[ab]*.md", "q[", "a.md"])
def test_glob(pattern):
    regex = text.glob_regex(pattern)
    for p in PATHS:
        assert bool(re.fullmatch(regex, p)) == fnmatch.fnmatchcase(p, pattern), (p, regex)


def test_file_filter(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    keep = lambda *rules: sorted(r.p for r in df.filter(text.is_indexable(F.col("p"), *rules)).collect())
    assert keep() == ["_under.md", "a.md", "b/C.TXT", "b/notes.log", "build/out/a.md", "q[1].md"]
    assert keep(["*.log", "build/*"], [".TXT"]) == ["_under.md", "a.md", "q[1].md"]


def test_strip_and_blank(spark):
    df = spark.createDataFrame([(" 　x y\xa0\n",), ("\t ",), ("",)], "t string")
    got = df.select(text.stripped(F.col("t")), text.is_blank(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("x y", False), ("", True), ("", True)]


def test_weights(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string")
    got = {(r.id, r.term): r.weight for r in sparse.postings(docs).collect()}
    assert set(got) == {(1, "a"), (1, "b")}
    assert math.isclose(got[1, "a"], 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 256)))
    idf = {(r.id, r.term): r.weight for r in sparse.with_idf(sparse.postings(docs)).collect()}
    assert set(idf) == set(got)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a")), vectors.normalised(F.col("a"))).collect()
    assert got[0][0] == 24.0 and got[0][1] == 5.0 and [round(x, 6) for x in got[0][2]] == [0.6, 0.8]
    assert got[1][2] == [None, None]
