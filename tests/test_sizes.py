"""What the engine leaves on disk and holds in a worker's memory."""

import json
import os
import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from lodestar.functions import sparse
from lodestar.functions.batches import each
from lodestar.operators import embedding, markdown
from lodestar.operators.embedding import HashingEmbedder
from lodestar.operators.store import Store
from lodestar.operators.sync import Settings
from lodestar.plans import retrieval
from lodestar.schemas import POINTS
from lodestar.service import Engine


def test_a_collection_of_one_version_is_small_and_leaves_no_copy(spark, tmp_path):
    """Points are written once, without an exchange, and postings take less room than the texts they come from."""
    rng = random.Random(5)
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{k % 97}" for k in range(3000)]
    folder = tmp_path / "docs"
    folder.mkdir()
    for k in range(60):
        (folder / f"{k}.txt").write_text(" ".join(rng.choices(words, k=1500)))
    text = sum(p.stat().st_size for p in folder.iterdir())
    engine = Engine(spark, str(tmp_path / "home"), Settings(HashingEmbedder(4)))
    engine.add("kb", str(folder))
    store = engine.store("kb")
    size = {t: sum(s["length"] for s in store.segments(t)) for t in ("points", "postings")}
    assert size["postings"] < text and size["points"] < text
    assert [len(store.files.names(os.path.join(store.path, t))) for t in ("points", "postings")] == [1, 1]
    rows = lambda df: {(r.id, t.term, round(t.weight, 12)) for r in df.collect() for t in r.terms}
    assert rows(sparse.weighted(store.read("postings"))) == rows(sparse.vectors(store.read("points"), stop_words=sparse.STOP_WORDS))


def test_segments_are_made_of_the_points_just_written(spark, tmp_path):
    """What is a function gets the stored points, also if there are none; if it fails, nothing is left."""
    store = Store(spark, str(tmp_path), "kb")
    point = lambda k: (f"p{k}", f"f{k}", 0, 1, "t", f"word w{k} w{k}" if k else "", [1.0])
    points = spark.createDataFrame([point(k) for k in range(4)], POINTS)
    made = lambda p: sparse.stored(p, keep=("source_file",))
    assert store.commit(0, dealt=("points", "postings"), points=points, postings=made) == 1
    got = {r.id: [(t.term, t.weight) for t in r.terms] for r in sparse.weighted(store.read("postings")).collect()}
    assert got == {r.id: [(t.term, t.weight) for t in r.terms] for r in sparse.vectors(points).collect()} and got["p0"] == []
    gone = spark.createDataFrame([("f1",)], "source_file string")
    assert store.change(1, dealt=("points",), points=(gone, points.limit(0)), postings=(gone, made)) == 2
    assert {r.id for r in store.read("postings").collect()} == {r.id for r in store.read("points").collect()} == {"p0", "p2", "p3"}
    before = {t: store.files.names(os.path.join(store.path, t)) for t in ("points", "postings")}
    with pytest.raises(ZeroDivisionError):
        store.change(2, points=(gone, points), postings=(gone, lambda p: 1 // 0))
    assert {t: store.files.names(os.path.join(store.path, t)) for t in before} == before and store.version() == 2


def test_trigrams_of_new_words_are_hashed_once():
    """Words that don't come again have trigrams that do; the hashes are those of word and trigrams, whoever keeps them."""
    import hashlib

    import numpy as np

    words = [f"{a}{b}{c}{d}{e}" for a in "bcdfg" for b in "aeiou" for c in "klmnp" for d in "aeiou" for e in "rstvw"]
    embedding._features.cache_clear()
    embedding._hash.cache_clear()
    got = HashingEmbedder(8).encode([" ".join(words), "", None])
    assert embedding._hash.cache_info().misses < 500 < embedding._features.cache_info().misses == len(words)
    want = np.zeros(8)
    for w in words:
        for part in (w, *(f"#{w}#"[k : k + 3] for k in range(len(w)))):
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
            want[h % 8] += 1 if h >> 63 else -1
    assert np.allclose(got[0], want / np.linalg.norm(want)) and not got[1:].any()


def test_versions_of_the_older_form_of_postings_are_passed_over(spark, tmp_path):
    store = Store(spark, str(tmp_path), "kb")
    store.commit(0, postings=sparse.stored(spark.createDataFrame([("a", "f", "x y")], "id string, source_file string, text string"), keep=("source_file",)))
    path = tmp_path / "kb" / "versions" / "1.json"
    old = json.loads(path.read_text())
    assert store.version() == 1
    path.write_text(json.dumps({k: v for k, v in old.items() if k != "form"}))
    assert store.version() == 0


def test_memory_of_the_sparse_leg_does_not_follow_common_terms(monkeypatch):
    """Every point and query holds the same words: millions of pairs, which aren't held at once."""
    words = [f"w{k}" for k in range(25)]
    texts = pa.array([words] * 150, pa.list_(pa.string()))
    asked = retrieval._Asked(pa.array(range(150)), texts)
    vector = [{"term": w, "weight": 0.5 + k / 64} for k, w in enumerate(words)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{k:05}" for k in range(4000)]), pa.array([vector] * 4000, pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())])))], ["id", "terms"])
    tracemalloc.start()
    try:
        (got,) = retrieval._best_sums(SimpleNamespace(value=asked), 3, 6)(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 << 20  # 15 million pairs, 8 bytes each, in several arrays
    score = round(sum(v["weight"] for v in vector), 6)
    assert got.to_pylist() == [{"query_id": q, "id": f"p{k:05}", "score": score} for q in range(150) for k in range(3)]


def test_memory_of_chunks_and_vectors_does_not_follow_the_batch():
    """A batch of 10,000 texts is worked on in parts, and words that come once aren't kept."""
    texts = pa.array([None, "", *("\n\n".join(f"# h{k}-{i}\n\nbody x{k}y{i} z" for i in range(25)) for k in range(10_000))])
    tracemalloc.start()
    try:
        cut = each(texts, markdown.chunks, pa.list_(pa.string()))
        chunking_peak = tracemalloc.get_traced_memory()[1]
        (vectors,) = embedding._udf(HashingEmbedder(4).encode).func(iter([texts[:2002]]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert chunking_peak < 30 << 20 and peak < 30 << 20
    assert cut[2:4].to_pylist() == [markdown.chunks(t) for t in texts[2:4].to_pylist()] and cut[:2].to_pylist() == [[], []]
    assert len(vectors) == 2002 and vectors[:2].to_pylist() == [[0.0] * 4] * 2
    assert vectors[-1].as_py() == HashingEmbedder(4).encode([texts[2001].as_py()])[0].tolist()
    assert embedding._features.cache_info().currsize <= embedding._features.cache_info().maxsize <= 20_000
