import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestar.cli import main
from lodestar.operators import chunking, quantised, stats
from lodestar.operators.catalog import Catalog
from lodestar.operators.embedding import HashingEmbedder
from lodestar.operators.store import ConcurrentWrite, Store, upsert
from lodestar.operators.sync import Settings
from lodestar.plans import retrieval
from lodestar.service import Engine
from lodestar.sources.contents import with_content
from lodestar.sources.folders import list_folder
from lodestar.storage import materialise


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "intro.md").write_text("# Intro\n\nThe engine searches notes.\n")
    (root / "usage.txt").write_text("Run the search with a query.")
    (root / "sub" / "faq.md").write_text("# FAQ\n\nAsk about lighthouses.\n")
    (root / "image.png").write_bytes(b"\x89PNG")
    (root / ".hidden.md").write_text("no")
    (root / "link.md").symlink_to(root / "intro.md")
    (root / "linked").symlink_to(root / "sub")
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "home"), Settings(HashingEmbedder(32)))


def age(path, by=-100):
    t = os.stat(path).st_mtime + by
    os.utime(path, (t, t))


def test_listing_skips_links_hidden_and_other_suffixes(spark, folder):
    names = lambda **k: sorted(r.rel_path for r in list_folder(spark, str(folder), **k).collect())
    assert names() == ["intro.md", "sub/faq.md", "usage.txt"]
    assert names(ignore_patterns=["sub/*"], ignore_extensions=[".TXT"]) == ["intro.md"]
    with pytest.raises(ValueError):
        list_folder(spark, str(folder / "absent"))


def test_content(spark, folder):
    (folder / "bad.txt").write_bytes(b"a\xff\r\nb")
    rows = {os.path.basename(r.file_path): r for r in with_content(list_folder(spark, str(folder))).collect()}
    assert rows["bad.txt"].text == "a�\nb" and rows["bad.txt"].found and len(rows["bad.txt"].file_hash) == 64
    gone = with_content(spark.createDataFrame([("/nowhere/x.md",)], "file_path string")).first()
    assert not gone.found and gone.text is None


def test_sync_life_cycle(engine, folder):
    assert engine.add("kb", str(folder)) == {"added": 3, "updated": 0, "deleted": 0}
    assert engine.store("kb").read("points").count() == 3
    version = engine.store("kb").version()
    assert engine.sync("kb") == {"added": 0, "updated": 0, "deleted": 0}
    assert engine.store("kb").version() == version  # nothing is written if nothing changed

    age(folder / "intro.md")  # touched: same content, other time
    assert engine.sync("kb") == {"added": 0, "updated": 0, "deleted": 0}
    assert engine.store("kb").version() == version + 1
    assert engine.sync("kb") == {"added": 0, "updated": 0, "deleted": 0} and engine.store("kb").version() == version + 1

    stat = os.stat(folder / "usage.txt")  # same time: skipped although changed
    (folder / "usage.txt").write_text("Changed words.")
    os.utime(folder / "usage.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert engine.sync("kb")["updated"] == 0
    engine.settings.force_hash = True
    assert engine.sync("kb")["updated"] == 1
    engine.settings.force_hash = False

    (folder / "sub" / "faq.md").unlink()
    (folder / "new.md").write_text("# New\n\nfresh")
    (folder / "intro.md").write_text("  \n")
    age(folder / "intro.md", 50)
    assert engine.sync("kb") == {"added": 1, "updated": 1, "deleted": 1}
    points = {os.path.basename(r.source_file) for r in engine.store("kb").read("points").collect()}
    assert points == {"usage.txt", "new.md"}  # a file that became blank has no points
    counts = {os.path.basename(r.file_path): r.chunk_count for r in engine.store("kb").read("files").collect()}
    assert counts == {"intro.md": 0, "usage.txt": 1, "new.md": 1}
    terms = {r.source_file for r in engine.store("kb").read("postings").select("source_file").distinct().collect()}
    assert {os.path.basename(t) for t in terms} == points
    assert engine.rebuild("kb") == {"added": 3, "updated": 0, "deleted": 0}


def test_search_end_to_end(engine, folder):
    engine.add("kb", str(folder))
    got = engine.search("kb", "lighthouses", top_k=2)
    assert os.path.basename(got[0]["source_file"]) == "faq.md" and "lighthouses" in got[0]["text"]
    assert set(got[0]) == {"text", "source_file", "chunk_index", "total_chunks", "score"}
    with pytest.raises(KeyError):
        engine.search("absent", "x")
    with pytest.raises(ValueError):
        engine.search("kb", "x", top_k=0)
    with pytest.raises(ValueError):
        engine.search("kb", "x", w_dense=2)


def test_status_health_and_removal(engine, folder):
    engine.add("kb", str(folder))
    status = engine.status("kb").first()
    assert (status.indexed_files, status.total_chunks, status.watching) == (3, 3, False)
    assert [r.indexed_files for r in engine.health().collect()] == [3]
    engine.remove("kb")
    assert engine.catalog.all() == {} and engine.store("kb").version() == 0
    with pytest.raises(KeyError):
        engine.remove("kb")


def test_failed_add_leaves_nothing(engine, tmp_path):
    with pytest.raises(ValueError):
        engine.add("kb", str(tmp_path / "absent"))
    assert engine.catalog.all() == {}


def test_model_change_rebuilds(engine, folder):
    engine.restore()
    engine.add("kb", str(folder))
    assert engine.restore() == {"kb": {"added": 0, "updated": 0, "deleted": 0}}
    engine.settings.embedder = HashingEmbedder(16)
    assert engine.restore() == {"kb": {"added": 3, "updated": 0, "deleted": 0}}
    assert len(engine.store("kb").read("points").first().dense) == 16


def test_watcher(engine, folder):
    engine.poll_seconds = 2
    engine.add("kb", str(folder))
    watcher = engine.watch("kb")
    try:
        assert engine.watch("kb") is watcher and watcher.running
        (folder / "late.md").write_text("# Late\n\nnote")
        end = time.time() + 90
        while time.time() < end and engine.store("kb").read("files").count() < 4:
            time.sleep(1)
        assert engine.store("kb").read("files").count() == 4
    finally:
        watcher.stop()
    assert not watcher.running


def test_catalog_rules(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    for name in ("", "a" * 65, "my docs", "my/docs", "my.docs", "@alias", "-start", "_start", "x\n"):
        with pytest.raises(ValueError):
            c.register(name, "/f")
    c.register("one", "/1", ["*.log"], [".PDF"])
    assert c.get("one") == {"folder_path": "/1", "ignore_patterns": ["*.log"], "ignore_extensions": [".pdf"]}
    for name, folder_ in (("one", "/2"), ("two", "/1")):
        with pytest.raises(ValueError, match="taken"):
            c.register(name, folder_)
    assert c.update("one", ignore_extensions=[".GIF"])["ignore_patterns"] == ["*.log"]
    assert c.update("one", ignore_patterns=["x"], clear_patterns=True)["ignore_patterns"] == []
    for k in range(3):
        c.register(f"n{k}", f"/n{k}")
    with pytest.raises(ValueError, match="4 collections"):
        c.register("more", "/more")
    assert c.table().count() == 4
    c.unregister("one")
    c.unregister("unknown")
    assert "one" not in c.all()
    assert [c.model_changed(*m)[0] for m in (("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"))] == [False, False, True, True]


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path), "kb")
    s.drop()
    assert s.read("files").count() == 0 and s.create() == 1 and s.create() == 1
    file = lambda p: spark.createDataFrame([(p, "h", 1.0, 1, 0.0)], s.read("files").schema)
    old = s.read("files")
    s.commit(1, files=file("/a"))
    with pytest.raises(ConcurrentWrite):
        s.commit(1, files=file("/b"))
    assert [r.file_path for r in s.read("files").collect()] == ["/a"] and old.count() == 0
    s.commit(2, files=upsert(s.read("files"), file("/a").union(file("/b")), "file_path"))
    assert s.read("files").count() == 2
    s.vacuum(1)
    assert len(os.listdir(tmp_path / "kb" / "files")) == 1 and s.version() == 3 and s.read("files").count() == 2


def test_keyed_replace_of_points(spark, tmp_path):
    from lodestar.operators.store import replace
    from lodestar.schemas import POINTS

    rows = [(f"{f}{k}", f, k, n, f, "t", [1.0]) for f, n in (("a", 3), ("b", 2)) for k in range(n)]
    points = spark.createDataFrame(rows, POINTS)
    changed = spark.createDataFrame([("a",)], "source_file string")
    got = replace(points, changed, points.filter("id = 'a0'"), "source_file")
    assert sorted(r.id for r in got.collect()) == ["a0", "b0", "b1"]


def test_fusion_and_rerank_ties(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "query_id long, id long, score double, rank int")
    fused = retrieval.rrf(ranks([(1, 10, 0.9, 1), (1, 11, 0.8, 2)]), ranks([(1, 11, 3.0, 1), (1, 12, 2.0, 2)]), 3)
    got = [(r.id, round(r.score, 6)) for r in fused.orderBy("rank").collect()]
    assert got == [(11, round(1 / 2 + 1 / 3, 6)), (10, 0.5), (12, round(1 / 3, 6))]
    points = spark.createDataFrame([(10, "x y"), (11, "x"), (12, "z")], "id long, text string")
    queries = spark.createDataFrame([(1, "x q")], "query_id long, text string")
    best = retrieval.rerank(fused, points, queries, 3).orderBy("rank").collect()
    assert [r.id for r in best] == [11, 10, 12]  # equal rerank scores keep the fused order
    weighted = retrieval.rrf(ranks([(1, 10, 0.9, 1)]), ranks([(1, 12, 2.0, 1)]), 2, weights=(0.1, 0.9)).orderBy("rank").collect()
    assert [r.id for r in weighted] == [12, 10]


def test_dense_in_blocks_equals_one_block(spark):
    points = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(40)], "id long, dense array<float>")
    queries = spark.createDataFrame([(k, [1.0, float(k), 0.5]) for k in range(6)], "query_id long, dense array<float>")
    one = retrieval.dense_topk(points, queries, 4)
    many = retrieval.dense_topk(points, queries, 4, bytes_per_row=retrieval.BROADCAST_BYTES // 2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_chunking(spark):
    long = " ".join(f"w{k}" for k in range(600))
    docs = spark.createDataFrame([(1, long), (2, "a b"), (3, " \n"), (4, None)], "id long, text string")
    windows = chunking.token_windows(docs).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.total_chunks, len(r.text.split())) for r in windows] == [(1, 0, 3, 256), (1, 1, 3, 256), (1, 2, 3, 152), (2, 0, 1, 2)]
    sliced = chunking.char_windows(docs).orderBy("id", "chunk_index").collect()
    assert [r.text for r in sliced if r.id == 1][-1].endswith("w599") and [r.id for r in sliced] == [1, 1, 1, 2]
    files = spark.createDataFrame([("/x/a.MD", "# H\n\np"), ("/x/b.markdown", "# H\n\np"), ("/x/c.txt", "")], "file_path string, text string")
    assert chunking.chunk_files(files).count() == 2
    back = chunking.reconstruct(windows and chunking.token_windows(docs).withColumnRenamed("id", "source_file"))
    assert {r.source_file: r.n_chunks for r in back.collect()} == {1: 3, 2: 1}


def test_tasks(spark):
    tasks = spark.createDataFrame([("c1", "/a", True), ("c1", "/b", False), ("c2", "/c", False)], "collection string, file_path string, in_progress boolean")
    assert {r.collection: tuple(r)[1:] for r in stats.task_status(tasks).collect()} == {"c1": (2, 1, 1), "c2": (1, 1, 0)}
    new = spark.createDataFrame([("c1", "/a"), ("c1", "/d"), ("c1", "/d"), ("c2", "/a")], "collection string, file_path string")
    assert sorted(map(tuple, stats.enqueue(tasks, new).collect())) == [("c1", "/d"), ("c2", "/a")]
    left, counts = stats.cancel(tasks, "c1")
    assert tuple(counts.first()) == (1, 1) and left.count() == 2


def test_latency_positions(spark):
    values = [float(v) for v in range(1, 51)]
    got = stats.latency(spark.createDataFrame([(v,) for v in values], "value double")).first()
    assert (got["mean"], got["median"], got["p95"], got["p99"], got["min"], got["max"]) == (25.5, 25.5, values[int(50 * 0.95)], values[int(50 * 0.99)], 1.0, 50.0)


def test_hashing_embedder_is_deterministic(spark):
    e = HashingEmbedder(16)
    df = spark.createDataFrame([("alpha beta",), (None,)], "t string").select(e.column(F.col("t")).alias("v"))
    got = [r.v for r in df.collect()]
    assert got[0] == pytest.approx(e.encode(["alpha beta"])[0].tolist()) and got[1] == [0.0] * 16


def test_cli(engine, folder, capsys):
    run = lambda *a: (main(list(a), engine), json.loads(capsys.readouterr().out))
    assert run("kb", "add", "kb", str(folder)) == (0, {"name": "kb", "added": 3, "updated": 0, "deleted": 0})
    code, found = run("search", "kb", "lighthouses", "--top-k", "1")
    assert code == 0 and len(found["results"]) == 1
    assert run("collection", "status", "kb")[1]["indexed_files"] == 3
    assert run("kb", "update", "kb", "--ignore-extension", ".TXT")[1]["ignore_extensions"] == [".txt"]
    assert run("collection", "sync", "kb")[1]["deleted"] == 1
    assert list(run("kb", "list")[1]["collections"]) == ["kb"]
    assert run("health")[1]["collections"][0]["indexed_files"] == 2
    code, failed = run("collection", "status", "absent")
    assert code == 1 and "absent" in failed["error"]
    assert run("kb", "remove", "kb")[0] == 0


def test_dense_topk_equals_brute_force(spark, monkeypatch):
    """Ties, odd vectors, several tiles, text ids, several blocks of queries."""
    import numpy as np

    from lodestar.plans import retrieval

    monkeypatch.setattr(retrieval, "TILE", (7, 3))
    rng = np.random.default_rng(8)
    vectors = [(f"p{k:03}", rng.integers(-2, 3, size=3).astype(float).tolist()) for k in range(150)]
    odd = [("x1", None), ("x2", [0.0, 0.0, 0.0]), ("x3", [1.0, 2.0]), ("x4", [float("nan"), 1.0, 0.0]), ("x5", [1.0, None, 0.0])]
    queries = [(k, rng.integers(-2, 3, size=3).astype(float).tolist()) for k in range(11)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    points, asked = spark.createDataFrame(vectors + odd, "id string, dense array<double>").repartition(3), spark.createDataFrame(queries, "query_id long, dense array<double>")
    want = set()
    for q, v in queries:
        if v and any(v):
            scored = sorted((-round(float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 6), i) for i, u in vectors if any(u))
            want |= {(q, i, r + 1) for r, (_, i) in enumerate(scored[:9])}
    for size in (None, retrieval.BROADCAST_BYTES // 3):
        got = {(r.query_id, r.id, r["rank"]) for r in retrieval.dense_topk(points, asked, 9, bytes_per_row=size).collect()}
        assert got == want
    assert retrieval.dense_topk(points, asked.limit(0), 9).count() == 0 and retrieval.dense_topk(points.limit(0), asked, 9).count() == 0


def _file(spark, *paths, hash="h"):
    return spark.createDataFrame([(p, hash, 1.0, 1, 0.0) for p in paths], Store(spark, "/none", "kb").read("files").schema)


def test_a_change_writes_in_proportion_to_the_file(spark, tmp_path):
    s = Store(spark, str(tmp_path), "kb")
    docs = spark.range(20_000).select(F.format_string("/d%d", F.col("id") % 2000).alias("source_file"), F.format_string("i%d", "id").alias("id"), F.col("id").cast("int").alias("chunk_index"), F.lit(10).alias("total_chunks"), F.lit("t").alias("title"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.array(F.lit(1.0)).alias("dense"))
    s.commit(0, points=docs)
    whole = s.segments("points")[0]["length"]
    key = spark.createDataFrame([("/d7",)], "source_file string")
    new = docs.filter("source_file = '/d7' AND chunk_index < 4000").withColumn("text", F.lit("new"))
    s.change(1, points=(key, new))
    old, added = s.segments("points")
    assert old["length"] == whole and added["length"] < whole / 100 and added["rows"] == 2 and added["marks"] == 1
    assert {(r.chunk_index, r.text) for r in s.scroll("/d7").collect()} == {(7, "new"), (2007, "new")} and s.read("points").count() == 19_992
    assert "EqualTo(source_file,/d7)" in s.scroll("/d7")._jdf.queryExecution().toString()


def test_segments_are_merged_by_size(spark, tmp_path, monkeypatch):
    from lodestar.operators import store

    big = lambda n: {"bytes": n * store.SMALL, "marks": 0, "seq": 0}
    assert store.due([big(100), *[big(0)] * 3], 4) is None and store.due([big(100), *[big(0)] * 4], 4) == 1
    assert store.due([big(100), *[big(2)] * 4, big(0)], 4) == 1 and store.due([big(100), *[big(2)] * 3, big(0)], 4) is None and store.due([big(0)] * 3, 4) is None
    s, want = Store(spark, str(tmp_path), "kb", fan=3), {}
    for k in range(7):
        paths = [f"/{(k * 5 + j) % 7}" for j in range(3)]
        gone, put = paths[:1], paths[1:]
        s.change(s.version(), files=(spark.createDataFrame([(p,) for p in paths], "p string"), _file(spark, *put, hash=f"h{k}")))
        want = {p: h for p, h in want.items() if p not in gone} | dict.fromkeys(put, f"h{k}")
        reader = s.version()
        before = s.read("files", reader)
        merged = s.compact()
        assert len(s.segments("files")) <= 3 and bool(merged) == (s.version() != reader)
        assert {r.file_path: r.file_hash for r in s.read("files").collect()} == want
        assert {r.file_path: r.file_hash for r in before.collect()} == want  # the reader's version is as it was
    s.compact(whole=True)
    assert len(s.segments("files")) == 1 and not s.segments("files")[0]["marks"] and s.segments("files")[0]["rows"] == len(want)
    # more marks than a reader broadcasts: they are joined, and merged away
    monkeypatch.setattr(store, "MARKS", 1)
    s.change(s.version(), files=(spark.createDataFrame([("/0",), ("/1",)], "p string"), _file(spark, "/9")))
    left = {p for p in want if p not in ("/0", "/1")} | {"/9"}
    assert {r.file_path for r in s.read("files").collect()} == left
    assert s.compact() == 2 and {r.file_path for r in s.read("files").collect()} == left


def test_a_merge_that_is_overtaken_goes_on_top(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), "kb", fan=2)
    s.commit(0, files=_file(spark, "/a", "/b"))
    s.change(1, files=(_file(spark, "/a").select("file_path"), _file(spark, "/a", hash="new")))
    swap = Store._swap

    def overtaken(self, *args):
        self.change(self.version(), files=(_file(spark, "/b").select("file_path"), _file(spark, "/c")))
        return swap(self, *args)

    monkeypatch.setattr(Store, "_swap", overtaken)
    assert s.compact() == 2
    assert {(r.file_path, r.file_hash) for r in s.read("files").collect()} == {("/a", "new"), ("/c", "h")} and len(s.segments("files")) == 2


def test_one_file_synchronised_again_and_again_leaves_no_more(engine, folder, tmp_path):
    """The disk doesn't grow, and a search goes on throughout."""
    engine.keep_seconds = 0
    engine.add("kb", str(folder))
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "home").rglob("*") if f.is_file())
    sizes = []
    for k in range(9):
        (folder / "usage.txt").write_text(f"Words of turn {k}.")
        age(folder / "usage.txt", 50 + k)
        assert engine.sync("kb")["updated"] == 1
        sizes.append(size())
    assert max(sizes[6:]) < 1.5 * max(sizes[:6]) and len(engine.store("kb").segments("points")) <= 8
    assert len(engine.store("kb")._numbers()) <= 2 and engine.store("kb").read("points").count() == 3


def test_a_broken_version_is_passed_over(spark, tmp_path):
    import shutil

    s = Store(spark, str(tmp_path), "kb")
    s.commit(0, files=_file(spark, "/a"))
    s.change(1, files=(_file(spark, "/b").select("file_path"), _file(spark, "/b")))
    assert {r.file_path for r in s.read("files").collect()} == {"/a", "/b"}
    (tmp_path / "kb" / "versions" / "3.json").write_text("{ not json")
    assert s.version() == 2 and s.broken() == [3]
    assert s.change(2, files=(_file(spark, "/a").select("file_path"), _file(spark, "/c").limit(0))) == 4
    assert [r.file_path for r in s.read("files").collect()] == ["/b"] and s.broken() == []
    s.commit(4, files=_file(spark, "/z"))
    s.commit(5, files=_file(spark, "/y"))
    part = next((tmp_path / "kb" / "files" / s.segments("files")[0]["folder"]).rglob("part-*"))
    part.write_bytes(part.read_bytes()[:-5])  # a truncated file
    assert s.version() == 5
    shutil.rmtree(tmp_path / "kb" / "files" / s.segments("files")[0]["folder"])  # its data has gone
    assert s.version() == 4 and [r.file_path for r in s.read("files").collect()] == ["/b"]
    s.vacuum(1)
    assert s._numbers() == [4] and s.read("files").count() == 1
    s.change(4, files=(_file(spark, "/b").select("file_path"), _file(spark, "/n")))
    s.vacuum(1, seconds=3600)  # versions and attempts of the last hour stay
    assert s._numbers() == [4, 5]


def test_store_on_a_hadoop_path(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/far", "kb")
    rows = spark.createDataFrame([("/a", "h", 1.0, 1, 0.0)], s.read("files").schema)
    assert s.commit(0, files=rows) == 1 and s.read("files").count() == 1
    with pytest.raises(ConcurrentWrite):
        s.commit(0, files=rows)
    assert not s.files.create(f"file://{tmp_path}/far/kb/versions/1.json", "x")
    s.drop()
    assert s.version() == 0


def test_engine_on_hadoop_paths(spark, folder, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/far", Settings(HashingEmbedder(8)))
    (folder / "linked").unlink()
    (folder / "link.md").unlink()  # a file system without links
    assert engine.add("kb", f"file://{folder}") == {"added": 3, "updated": 0, "deleted": 0}
    assert engine.sync("kb") == {"added": 0, "updated": 0, "deleted": 0}
    (folder / "usage.txt").unlink()
    assert engine.sync("kb")["deleted"] == 1
    assert sorted(r.title for r in engine.store("kb").read("points").collect()) == ["faq", "intro"]
    with pytest.raises(ValueError):
        list_folder(spark, f"file://{folder}/absent")


def test_listing_is_cut_into_many_partitions(spark, tmp_path):
    from lodestar.sources import folders

    for k in range(6):
        (tmp_path / "one" / f"d{k}" / "deep").mkdir(parents=True)
        (tmp_path / "one" / f"d{k}" / "deep" / "x.md").write_text("x")
        (tmp_path / "one" / f"d{k}" / "y.md").write_text("y")
    parts = folders.FolderReader(str(tmp_path)).partitions()
    assert len(parts) > 6 and list_folder(spark, str(tmp_path)).select("file_path").distinct().count() == list_folder(spark, str(tmp_path)).count() == 12


def test_an_error_stays_with_its_file(spark, folder, tmp_path):
    class Failing(HashingEmbedder):
        """Can't embed a text that holds "poison". Local, so that it is sent to the workers by value."""

        def encode(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("can't embed this")
            return HashingEmbedder.encode(self, texts)

    engine = Engine(spark, str(tmp_path / "home"), Settings(Failing(8)))
    (folder / "bad.txt").write_text("poison")
    counts = engine.add("kb", str(folder))
    assert counts["added"] == 3 and counts["failed"] == 1
    assert {os.path.basename(r.file_path) for r in engine.store("kb").read("files").collect()} == {"intro.md", "usage.txt", "faq.md"}
    (folder / "good.txt").write_text("fine")
    paths = [str(folder / "good.txt"), str(folder / "bad.txt")]
    assert engine.enqueue("kb", paths) == 2 and engine.wait("kb", 120)
    assert list(engine.queue.failed) == [("kb", str(folder / "bad.txt"))]
    assert "good.txt" in {os.path.basename(r.file_path) for r in engine.store("kb").read("files").collect()}


def _tasks(spark, tmp_path, **options):
    from lodestar.operators.tasks import Tasks

    return Tasks(Store(spark, str(tmp_path), "tasks"), **options)


def _new(spark, *rows):
    return spark.createDataFrame(rows, "collection string, file_path string")


def test_tasks_are_held_by_one_worker_until_the_lease_ends(spark, tmp_path):
    t = _tasks(spark, tmp_path, seconds=600)
    assert t.claim("w0") is None and t.cancel("a") == {"collection": "a", "queued_removed": 0, "in_progress_tasks": 0}
    assert t.enqueue(_new(spark, ("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"))) == 3 and t.enqueue(_new(spark, ("a", "1"))) == 0
    assert t.claim("w1", 1) == ("a", ["1"])
    other = _tasks(spark, tmp_path, seconds=600)  # another driver
    assert other.claim("w2") == ("a", ["2"]) and other.claim("w2") == ("b", ["1"]) and other.claim("w3") is None
    assert t.enqueue(_new(spark, ("a", "1"))) == 0  # held ones are pending
    assert t.finish("w1", "a", ["1", "2"]) == 1  # the other isn't its own
    assert other.finish("w2", "a", ["2"], {"2": "broken"}) == 1 and other.failed() == {("a", "2"): "broken"}
    assert sorted(map(tuple, t.pending().collect())) == [("b", "1", True)]
    assert t.enqueue(_new(spark, ("a", "2"))) == 1 and t.failed() == {}  # a failed task may come again
    assert t.cancel("a")["queued_removed"] == 1 and t.cancel("b") == {"collection": "b", "queued_removed": 0, "in_progress_tasks": 1}
    # the driver of w2 has ended: when its lease is over, another worker gets the task, and what w2 says no longer counts
    t.seconds = 0.0
    assert t.enqueue(_new(spark, ("c", "1"))) == 1 and t.claim("w4") == ("c", ["1"]) and t.claim("w5") == ("c", ["1"])
    assert t.finish("w4", "c", ["1"]) == 0 and t.finish("w5", "c", ["1"]) == 1


def test_workers_that_meet_share_the_tasks(spark, tmp_path):
    import threading

    t = _tasks(spark, tmp_path)
    t.enqueue(_new(spark, *[("a", f"{k}") for k in range(12)]))
    got, lock = [], threading.Lock()

    def work(name):
        mine = _tasks(spark, tmp_path)
        while (taken := mine.claim(name, 4)) is not None:
            with lock:
                got.extend(taken[1])

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(3)]
    [x.start() for x in threads], [x.join(240) for x in threads]
    assert sorted(got, key=int) == [f"{k}" for k in range(12)]


def test_tasks_outlive_the_driver(spark, folder, tmp_path):
    first = Engine(spark, str(tmp_path / "home"), Settings(HashingEmbedder(8)))
    first.add("kb", str(folder))
    (folder / "new.txt").write_text("words")
    first.queue.tasks.seconds = 1.0
    first.queue.start = lambda: None  # it ends before a worker begins, and after one has claimed
    assert first.enqueue("kb", [str(folder / "new.txt")]) == 1 and first.queue.tasks.claim("lost")[0] == "kb"
    second = Engine(spark, str(tmp_path / "home"), Settings(HashingEmbedder(8)))
    second.queue.tasks.seconds = 30.0
    second.queue.start()
    try:
        assert second.wait("kb", 120) and second.store("kb").read("files").count() == 4
    finally:
        second.queue.stop()


def test_a_busy_collection_is_not_removed(engine, folder):
    from lodestar.service import Busy

    engine.add("kb", str(folder))
    with engine._working("kb"):
        with pytest.raises(Busy):
            engine.remove("kb", timeout=0.1)
        assert "kb" in engine.catalog.all()
    engine._busy["kb"] = -1
    with pytest.raises(Busy):
        engine.sync("kb")
    engine._busy["kb"] = 0
    engine.remove("kb")
    assert engine.catalog.all() == {}


def test_a_watcher_survives_errors(spark):
    from lodestar.streaming.watch import Watcher

    calls = []

    def sync():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("out of reach")
        return {"added": len(calls)}

    w = Watcher(spark, "kb", sync, 1)
    w.start()
    try:
        end = time.time() + 60
        while time.time() < end and len(w.beats) < 3:
            time.sleep(0.2)
        assert list(w.beats)[:3] == [{"error": "out of reach"}, {"added": 2}, {"added": 3}] and w.running
    finally:
        w.stop()


@pytest.mark.parametrize("by", ["beat", "digest"])
def test_a_running_batch_ends_before_its_stream_stops(spark, folder, tmp_path, by):
    import threading

    from lodestar.streaming.folder import FolderStream
    from lodestar.streaming.watch import Watcher

    began = threading.Event()

    def run(*_):
        began.set()
        for _ in range(8):
            spark.range(1000).repartition(3).count()
            time.sleep(0.2)
        return {"added": 1}

    w = Watcher(spark, "kb", run, 1) if by == "beat" else FolderStream(spark, "kb", str(folder), str(tmp_path / "state"), run, 1)
    w.start()
    assert began.wait(60) and w.stop(0.1) is False and w.running and not w.beats
    assert w.stop() and not w.running and list(w.beats)[0] == {"added": 1} and not any("error" in b for b in w.beats)


def test_marks_merge_a_table_only_when_they_are_many_of_its_rows():
    from lodestar.operators import store

    part = lambda rows, marks: {"bytes": 10 * rows, "rows": rows, "marks": marks}
    many = 2 * store.MARKS
    assert store.due([part(100 * many, 0), part(many, many)]) is None
    assert store.due([part(many, 0), part(many // 2, many)]) == 0 and store.due([part(many, 0), part(9, 9)]) is None


def test_a_sync_leaves_no_listing_behind(engine, folder):
    from lodestar import storage

    before = set(storage._WRITTEN)
    engine.add("kb", str(folder))
    (folder / "more.md").write_text("more")
    assert engine.sync("kb")["added"] == 1 and set(storage._WRITTEN) <= before


def test_tasks_look_at_their_files_only(spark, engine, folder, monkeypatch):
    """The rows are those of the listing, and the folder isn't walked for a batch of tasks."""
    from lodestar.sources import folders

    (folder / ".out").mkdir()
    (folder / ".out" / "a.md").write_text("a")
    (folder / "also").symlink_to(folder / ".out")
    (folder / "also.md").symlink_to(folder / ".out" / "a.md")
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / "deep" / "er" / "b.md").write_text("b")
    listed = sorted(map(tuple, folders.list_folder(spark, str(folder), ["x/*"], [".log"]).collect()))
    names = [r[0] for r in listed] + [str(folder / n) for n in (".out/a.md", "also/a.md", "also.md", "deep", "absent.md", "deep/../deep/er/b.md")] + ["/etc/hosts", None]
    asked = spark.createDataFrame([(n,) for n in names + names], "file_path string")
    assert sorted(map(tuple, folders.list_named(spark, str(folder), asked, ["x/*"], [".log"]).collect())) == listed and len(listed) > 1
    engine.add("kb", str(folder))
    (folder / "deep" / "er" / "b.md").write_text("b, and more")
    os.utime(folder / "deep" / "er" / "b.md", (5, 5))

    def walked(*_):
        raise AssertionError("the folder is walked")

    monkeypatch.setattr(folders.FolderReader, "partitions", walked)
    assert engine._index("kb", [str(folder / "deep" / "er" / "b.md")])["updated"] == 1


def test_tasks_on_the_command_line(engine, folder, capsys):
    engine.add("kb", str(folder))
    assert main(["collection", "tasks", "kb"], engine) == 0
    assert json.loads(capsys.readouterr().out)["pending_tasks"] == 0
    assert main(["kb", "update", "kb", "--ignore", "*.log", "--ignore-ext", ".X"], engine) == 0
    assert json.loads(capsys.readouterr().out)["ignore_extensions"] == [".x"]
    assert main(["collection", "tasks", "absent"], engine) == 1


def test_cells_are_exact_when_all_are_probed_and_near_it_otherwise(spark, tmp_path):
    import numpy as np

    from lodestar.operators import cells

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    vectors = [(f"p{k:04}", (centres[k % 30] + 0.35 * rng.normal(size=12)).tolist()) for k in range(1500)]
    points = spark.createDataFrame([*vectors, ("odd", None), ("zero", [0.0] * 12)], "id string, dense array<double>")
    asked = points.filter("substring(id, 5, 1) = '7'").limit(60).select(F.regexp_extract("id", r"\d+", 0).cast("long").alias("query_id"), "dense")
    index = cells.CellIndex(spark, str(tmp_path / "cells"))
    with pytest.raises(ValueError):
        index.search(asked, 5, 4)
    index.build(points, 40)
    rows = lambda df: {(r.query_id, r.id, r["rank"]) for r in df.collect()}
    exact = rows(retrieval.dense_topk(points, asked, 5))
    cells.POINTS_IN_TASK, before = 20, cells.POINTS_IN_TASK  # cells of several parts
    try:
        assert rows(index.search(asked, 5, 40)) == exact and len(exact) > 100
    finally:
        cells.POINTS_IN_TASK = before
    found = rows(index.search(asked, 5, 8))
    hits = len({(q, i) for q, i, _ in found} & {(q, i) for q, i, _ in exact})
    assert hits / len(exact) >= 0.9
    assert index.search(asked.limit(0), 5, 4).count() == 0
    index.build(points.limit(0))
    assert index.search(asked, 5, 4).count() == 0


def test_search_through_an_index(engine, folder):
    engine.add("kb", str(folder))
    engine.build_index("kb", 2)
    assert engine.search("kb", "lighthouses", probes=2) == engine.search("kb", "lighthouses")
    assert len(engine.search("kb", "the and of")) == 3  # stop words alone: the dense leg only
    with pytest.raises(ValueError, match="no index"):
        engine.index("kb", 1)
    # the index is in step after syncs, and after a rebuild with another model
    (folder / "new.txt").write_text("zebras graze")
    (folder / "usage.txt").unlink()
    engine.sync("kb")
    ids = lambda t: {r.id for r in engine.store("kb").read(t).collect()}
    assert ids("codes") == ids("points") and len(ids("codes")) == 3
    assert engine.search("kb", "zebras", probes=2, top_k=1)[0]["source_file"].endswith("new.txt")
    model = engine.store("kb").model()
    for k in range(5):
        (folder / f"more{k}.txt").write_text(f"animal number {k}")
    engine.sync("kb")  # twice the size: fitted anew
    assert engine.store("kb").model() != model and ids("codes") == ids("points") and engine.store("kb").model()["points"] == 8
    engine.settings.embedder = HashingEmbedder(16)
    engine.rebuild("kb")
    assert quantised.Model.from_dict(engine.store("kb").model()).dim == 16 and ids("codes") == ids("points")
    assert engine.search("kb", "zebras", probes=99, top_k=1) == engine.search("kb", "zebras", top_k=1)


def test_quantised_index_recall_and_cases(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    made = lambda k: (centres[k % 40] + 0.4 * rng.normal(size=24)).tolist()
    rows = [(f"p{k:04}", f"/f{k % 200}", made(k)) for k in range(3000)] + [("odd", "/o", None), ("zero", "/o", [0.0] * 24), ("short", "/o", [1.0]), ("nan", "/o", [float("nan")] * 24)]
    points = spark.createDataFrame(rows, "id string, source_file string, dense array<float>")
    asked = spark.createDataFrame([(k, made(k)) for k in range(60)] + [(99, None), (98, [0.0] * 24)], "query_id long, dense array<double>")
    model = quantised.Model.from_dict(json.loads(json.dumps(quantised.fit(points, 48).to_dict())))
    index = quantised.Index(quantised.encoded(points, model), model)
    assert index.codes.count() == 3000
    found = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = retrieval.dense_topk(points, asked, 10)
    assert found(index.search(asked, 10, 48, refine=300)) == found(exact) and len(found(exact)) == 600
    recall = len(found(index.search(asked, 10, 8)) & found(exact)) / 600
    assert recall >= 0.9
    scores = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(r.score - scores[r.query_id, r.id]) < 2e-6 for r in index.search(asked, 10, 8).collect() if (r.query_id, r.id) in scores)
    most = quantised.CANDIDATES
    try:
        quantised.CANDIDATES = 1600  # several blocks of queries
        assert found(index.search(asked, 10, 8)) == found(index.search(asked, 10, 8, refine=8))
    finally:
        quantised.CANDIDATES = most
    empty = quantised.fit(points.limit(0))
    assert quantised.Index(quantised.encoded(points, empty), empty).search(asked, 5, 3).count() == 0


# ---- a tiny ONNX model, written by hand: fields of its protocol buffer


def _field(number, value):
    def varint(n):
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _onnx(nodes, inputs, output, dims):
    attribute = lambda name, v: _field(1, name) + (_field(3, v) + _field(20, 2) if isinstance(v, int) else b"".join(_field(8, x) for x in v) + _field(20, 7))
    node = lambda op, ins, out, attrs: b"".join(_field(1, i) for i in ins) + _field(2, out) + _field(4, op) + b"".join(_field(5, attribute(k, v)) for k, v in attrs.items())
    value = lambda name, kind, n: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, b"".join(_field(1, _field(2, f"d{k}")) for k in range(n)))))
    graph = b"".join(_field(1, node(*n)) for n in nodes) + _field(2, "g") + b"".join(_field(11, value(i, 7, 2)) for i in inputs) + _field(12, value(output, 1, dims))
    return _field(1, 6) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 11))


@pytest.fixture
def model_folder(tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    words = Tokenizer(WordLevel({w: k for k, w in enumerate(["[PAD]", "[UNK]", "red", "green", "blue"])}, unk_token="[UNK]"))
    words.pre_tokenizer = Whitespace()
    words.save(str(tmp_path / "tokenizer.json"))
    # The hidden state of a token is (id, 1 - id / 10 ...) in two parts: its id twice.
    (tmp_path / "model.onnx").write_bytes(_onnx([("Cast", ["input_ids"], "f", {"to": 1}), ("Unsqueeze", ["f"], "u", {"axes": [2]}), ("Mul", ["u", "u"], "s", {}), ("Concat", ["u", "s"], "h", {"axis": 2})], ["input_ids", "attention_mask"], "h", 3))
    (tmp_path / "cross.onnx").write_bytes(_onnx([("Mul", ["input_ids", "attention_mask"], "m", {}), ("Cast", ["m"], "f", {"to": 1}), ("ReduceSum", ["f"], "r", {"axes": [1], "keepdims": 1})], ["input_ids", "attention_mask"], "r", 2))
    return tmp_path


def test_onnx_embedder_and_reranker(spark, model_folder):
    import numpy as np

    from lodestar.operators.embedding import OnnxEmbedder, OnnxReranker

    texts = ["red green blue", "blue", None, "red"] + ["green blue"] * 150
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: np.array(r.v) for r in df.select("id", OnnxEmbedder(str(model_folder), 2).column(F.col("text")).alias("v")).collect()}
    for k, text in enumerate(texts):
        ids = np.array([{"red": 2, "green": 3, "blue": 4}[w] for w in (text or "").split()] or [0.0])
        want = np.array([ids.mean(), (ids**2).mean()])
        assert np.allclose(got[k], want / max(np.linalg.norm(want), 1e-12), atol=1e-5)
    fused = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.4, 2), (1, 3, 0.3, 3)], "query_id long, id long, score double, rank int")
    asked = spark.createDataFrame([(1, "red")], "query_id long, text string")
    best = retrieval.rerank(fused, df, asked, 2, scorer=OnnxReranker(str(model_folder), "cross.onnx")).orderBy("rank").collect()
    assert [(r.id, r.rerank_score) for r in best] == [(0, 11.0), (1, 6.0)]


def test_windows_with_a_tokenizer_file(spark, model_folder):
    docs = spark.createDataFrame([("a.txt", "red  green, blue red green"), ("b.txt", " "), ("c.md", "# red\n\nblue")], "file_path string, text string")
    got = chunking.chunk_files(docs, tokenizer_file=str(model_folder / "tokenizer.json")).collect()
    assert sorted((r.file_path, r.chunk_index, r.text) for r in got) == [("a.txt", 0, "red  green, blue red green"), ("c.md", 0, "# red\n\nblue")]
    cut = chunking.char_windows(docs.filter("file_path = 'a.txt'"), str(model_folder / "tokenizer.json"), size=3, overlap=1).orderBy("chunk_index").collect()
    assert [r.text for r in cut] == ["red  green,", ", blue red", "red green"]


def test_writers_take_turns_and_try_again(engine, folder, monkeypatch):
    import threading

    from lodestar import service

    engine.add("kb", str(folder))
    (folder / "x.md").write_text("one more")
    (folder / "y.md").write_text("and one more")
    threads = [threading.Thread(target=engine.sync, args=("kb",)) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert engine.store("kb").read("files").count() == 5
    real, calls = service.sync_apart, []

    def overtaken(*args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            raise ConcurrentWrite("another engine was first")
        return real(*args, **kwargs)

    monkeypatch.setattr(service, "sync_apart", overtaken)
    (folder / "z.md").write_text("the last one")
    assert engine.sync("kb")["added"] == 1 and len(calls) == 2


def test_sparse_topk_equals_brute_force(spark, monkeypatch):
    """Postings and vectors, several tiles and blocks of queries, ties, and queries without terms."""
    import random

    from lodestar.functions import sparse

    rng = random.Random(6)
    word = lambda: f"w{min(rng.randrange(30), rng.randrange(30))}"
    texts = [(f"p{k:03}", " ".join(word() for _ in range(rng.randrange(0, 25)))) for k in range(120)] + [("null", None)]
    queries = [(k, " ".join(word() for _ in range(rng.randrange(0, 6)))) for k in range(23)] + [(99, None), (98, "unknown words")]
    points, asked = spark.createDataFrame(texts, "id string, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    want = set()
    for q, text in queries:
        scored = []
        for i, t in texts:
            ws = (t or "").split()
            shared = set((text or "").split()) & set(ws)
            if shared:
                scored.append((-round(sum((c := ws.count(w)) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / 256.0)) for w in sorted(shared)), 6), i))
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:7])}
    rows = lambda df: {(r.query_id, r.id, r["rank"]) for r in df.collect()}
    for scores, block, sent in ((1 << 21, 10_000, 1 << 23), (60, 5, 1 << 23), (60, 10_000, 60)):
        monkeypatch.setattr(retrieval, "SCORES", scores)
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", sent)
        monkeypatch.setattr(retrieval, "QUERIES", block)
        assert rows(retrieval.sparse_topk(sparse.postings(points), asked, 7)) == want
        assert rows(retrieval.sparse_topk(sparse.postings(points), asked, 7, few_terms=1000)) == want
        assert rows(retrieval.sparse_topk(sparse.vectors(points), asked, 7)) == want
    assert retrieval.sparse_topk(sparse.vectors(points.limit(0)), asked, 7).count() == 0 and retrieval.sparse_topk(sparse.postings(points), asked.limit(0), 7).count() == 0


# ---- contents


def test_one_changed_file_among_many_is_read_alone(spark, tmp_path):
    from lodestar.sources.contents import write_files

    root = tmp_path / "many"
    docs = spark.range(3_000).select(F.format_string("d%d/f%d.md", F.col("id") % 20, "id").alias("rel_path"), F.format_string("text %d", "id").alias("content"), F.lit(5.0).alias("at"))
    assert write_files(docs, str(root), mtime="at") == 3_000
    read = spark.sparkContext.accumulator(0)
    for place, path in (("bare", str(root)), ("far", f"file://{root}")):
        engine = Engine(spark, str(tmp_path / place), Settings(HashingEmbedder(8), read=read))
        assert engine.add("kb", path)["added"] == 3_000
        (root / "d3" / "f3.md").write_text(f"changed for {place}")
        before = read.value
        assert engine.sync("kb") == {"added": 0, "updated": 1, "deleted": 0}
        assert read.value - before == 2  # once to compare and once to cut
        assert engine.sync("kb")["updated"] == 0 and read.value - before == 2
        os.utime(root / "d3" / "f3.md", (5, 5))


def test_contents_stream_one_file_at_a_time(monkeypatch, tmp_path):
    import pyarrow as pa

    from lodestar.sources import contents

    monkeypatch.setattr(contents, "FLUSH", 100)
    sizes = [10, 20, 500, 30, 80, 5]
    for k, n in enumerate(sizes):
        (tmp_path / f"{k}.txt").write_bytes(b"x" * n)
    names = [str(tmp_path / f"{k}.txt") for k in range(6)] + [str(tmp_path / "gone.txt"), None]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(range(8))], ["file_path", "k"])
    got = list(contents._reader("file_path")(iter([batch])))
    assert [[len(c or b"") for c in b.column("content").to_pylist()] for b in got] == [[10, 20, 500], [30, 80], [5, 0, 0]]
    assert [k for b in got for k in b.column("k").to_pylist()] == list(range(8)) and got[-1].column("found").to_pylist() == [True, False, False]


def test_files_are_dealt_by_bytes(spark, monkeypatch):
    from lodestar.sources import contents

    files = spark.range(1000).select(F.format_string("/none/%d", "id").alias("file_path"), F.lit(1 << 20).alias("size"))
    assert contents._tasks(files) == 16 and contents._tasks(files.drop("size")) == 1 and contents._tasks(files.limit(0)) == 1
    assert with_content(files).rdd.getNumPartitions() == 16


@pytest.mark.parametrize("most", [1000, 2])
def test_contents_by_sparks_own_source(spark, tmp_path, monkeypatch, most):
    """Where workers can't open a path, Spark reads the named files only."""
    from lodestar.sources import contents

    monkeypatch.setattr(contents, "workers_can_open", lambda folder: False)
    monkeypatch.setattr(contents, "PATHS", most)
    for name in ("a.md", "b[1].md", "c{2}.md", "d.md"):
        (tmp_path / name).write_text(f"text of {name}\r\n")
    rows = [(f"file:{tmp_path}/{n}", k) for k, n in enumerate(("a.md", "b[1].md", "c{2}.md", "gone.md", "a.md"))]
    got = with_content(spark.createDataFrame(rows, "file_path string, k int"), folder=f"file://{tmp_path}")
    assert sorted((r.k, r.text, r.found) for r in got.collect()) == [(0, "text of a.md\n", True), (1, "text of b[1].md\n", True), (2, "text of c{2}.md\n", True), (3, None, False), (4, "text of a.md\n", True)]
    if most > 2:
        assert not any("d.md" in f for f in got.inputFiles())


# ---- block-max index


def test_block_max_index_equals_plain_sums(spark, monkeypatch):
    """Several shards, blocks, passes and ties; fewer postings are looked at than there are."""
    import random

    from lodestar.functions import sparse
    from lodestar.operators import inverted

    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    texts = [(f"p{k:04}", " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(1500)] + [("null", None)]
    queries = [(k, " ".join(word() for _ in range(rng.randrange(0, 15)))) for k in range(40)] + [(99, None), (98, "unknown words")]
    points, asked = spark.createDataFrame(texts, "id string, text string").repartition(2), spark.createDataFrame(queries, "query_id long, text string")
    vectors = sparse.vectors(points)
    rows = lambda df: {(r.query_id, r.id, r["rank"], r.score) for r in df.collect()}
    want = rows(retrieval.sparse_topk(vectors, asked, 10))
    shares = []
    for postings, block, sent in ((1 << 20, 64, 1 << 23), (3000, 8, 1 << 23), (3000, 3, 700)):
        monkeypatch.setattr(inverted, "POSTINGS", postings)
        monkeypatch.setattr(inverted, "BLOCK", block)
        monkeypatch.setattr(inverted, "BROADCAST_BYTES", sent)
        counts = [spark.sparkContext.accumulator(0) for _ in range(2)]
        blocks = materialise(inverted.build(vectors), "blocks")
        assert rows(inverted.search(blocks, asked, 10, counts=counts)) == want
        shares.append(counts[0].value / counts[1].value)
    assert max(shares) < 0.8, shares
    empty = inverted.build(sparse.vectors(points.limit(0)))
    assert inverted.search(empty, asked, 3).count() == 0 and inverted.search(blocks, asked.limit(0), 3).count() == 0


def test_a_long_log_is_read_in_pieces(tmp_path, monkeypatch):
    import pyarrow as pa

    from lodestar.sources import logs

    monkeypatch.setattr(logs, "PIECE", 20)
    lines = ["first line", "second", "a line that is longer than a piece", "", "last"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    at, got, calls = 0, [], 0
    read = getattr(logs._tail, "func", None)
    while True:
        found = read(pa.array([str(tmp_path / "a.log")]), pa.array([at])).to_pylist()[0]
        if found["position"] == at:
            break
        at, calls = found["position"], calls + 1
        got += found["lines"]
    assert got == [x for x in lines if x] and calls == 3 and at == (tmp_path / "a.log").stat().st_size


# ---- the folder as a stream


def test_listing_digest(tmp_path):
    from lodestar.streaming.folder import listing_digest

    seen = {listing_digest(str(tmp_path))}
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path)
    assert listing_digest(str(tmp_path)) in seen
    for step in (lambda: (tmp_path / "sub" / "a").write_text("1"), lambda: (tmp_path / "sub" / "a").write_text("22"), lambda: age(tmp_path / "sub" / "a"), lambda: (tmp_path / "sub" / "a").rename(tmp_path / "b"), lambda: (tmp_path / "b").unlink() or (tmp_path / "c").write_text("")):
        step()
        now = listing_digest(str(tmp_path))
        assert now not in seen and now == listing_digest(str(tmp_path))
        seen.add(now)


def wait_for(condition, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.3)
    return condition()


def test_a_replayed_batch_commits_once(spark, folder, tmp_path):
    """The driver ends between the version's commit and the checkpoint's; the restarted stream runs the batch again."""
    from lodestar.streaming.folder import FolderStream

    engine = Engine(spark, str(tmp_path / "home"), Settings(HashingEmbedder(8)))
    engine.add("kb", str(folder))
    (folder / "late.md").write_text("# Late\n\nnote")
    calls = []

    def run(stream, batch):
        calls.append((stream, batch, engine._run("kb", batch=(stream, batch)), engine.store("kb").version()))
        return calls[-1][2]

    first, second = (FolderStream(spark, "kb", str(folder), str(tmp_path / "home" / "state"), run, 1) for _ in range(2))
    commits = lambda: [f for f in (tmp_path / "home" / "state").glob("checkpoint-*/commits/*") if f.name.strip(".crc") == "0"]
    first.start()
    assert wait_for(lambda: calls and commits())
    first.stop()
    for f in commits():  # what a driver that ended before would have left
        f.unlink()
    second.start()
    try:
        assert wait_for(lambda: len(calls) == 2)
        (one, again) = calls
        assert one[:2] == again[:2] and one[2]["added"] == 1 and not any(again[2].values()) and one[3] == again[3]
        (folder / "usage.txt").unlink()
        assert wait_for(lambda: len(calls) == 3) and calls[2][1] == one[1] + 1 and calls[2][2]["deleted"] == 1
        time.sleep(3)  # nothing changes: no batch
        assert len(calls) == 3
    finally:
        second.stop()
    assert engine.store("kb").batch(one[0]) == one[1] + 1 and engine.store("kb").batch("other") == -1


def test_a_failed_batch_is_tried_again(spark, folder, tmp_path):
    from lodestar.streaming.folder import FolderStream

    calls = []

    def run(stream, batch):
        calls.append(batch)
        if len(calls) < 3:
            raise RuntimeError("out of reach")
        return {"added": 1}

    stream = FolderStream(spark, "kb", str(folder), str(tmp_path / "state"), run, 1)
    stream.start()
    try:
        assert wait_for(lambda: len(calls) == 3) and stream.running
        assert wait_for(lambda: len(stream.beats) == 3) and [("error" in b) for b in stream.beats] == [True, True, False]
    finally:
        stream.stop()


@pytest.mark.parametrize("by", ["k", None])
def test_order_statistics_equal_sorted_lists(spark, monkeypatch, by):
    """Values of all sizes, ties, one value and negative ones; narrowed in rounds and at once."""
    import math
    import random

    rng = random.Random(12)
    rows = [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)] + [("near", 1e15 + rng.randrange(500)) for _ in range(900)]
    rows += [("ties", float(rng.randrange(4))) for _ in range(400)] + [("one", 7.5)] * 90 + [("few", 1.0), ("few", 2.0), ("few", None)] + [("skewed", rng.paretovariate(0.2)) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(3)
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k if by else "", []).append(v)
    want = {}
    for k, vs in groups.items():
        vs.sort()
        n = len(vs)
        want[k] = ((vs[(n - 1) // 2] + vs[-(-(n - 1) // 2)]) / 2, vs[min(math.floor(n * 0.95), n - 1)], vs[min(math.floor(n * 0.99), n - 1)], vs[0], vs[-1])
    for left, parts in ((100_000, 256), (30, 32)):
        monkeypatch.setattr(stats, "LEFT", left)
        monkeypatch.setattr(stats, "PARTS", parts)
        got = stats.latency(df, by=by)
        assert {r[by] if by else "": (r.median, r.p95, r.p99, r.min, r.max) for r in got.collect()} == want
        assert "Window" not in got._jdf.queryExecution().toString()
    assert stats.latency(df.limit(0), by=by).count() == 0


def test_word_windows_equal_a_plain_loop(spark):
    import random
    import re

    rng = random.Random(3)
    gap = lambda: rng.choice([" ", "  ", ", ", "\n", " - ", ".\n\n"])
    text = lambda n: rng.choice(["", "(", " "]) + "".join(rng.choice(["a", "word", "été", "x1", "日本", "_"]) + gap() for _ in range(n))
    texts = [text(n) for n in (0, 1, 9, 10, 11, 17, 18, 19, 20, 33, 34, 35, 100)] + ["!!!", "  ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for size, overlap in ((10, 2), (10, 0), (3, 1)):
        want = []
        for k, t in enumerate(texts):
            spans = [m.span() for m in re.finditer(r"\w+", t or "")]
            starts = [s for s in range(0, max(1, len(spans) - overlap), size - overlap)] if len(spans) > size else [0]
            pieces = [t] if len(spans) <= size else [t[spans[s][0] : spans[min(s + size, len(spans)) - 1][1]] for s in starts]
            want += [(k, len(pieces), i, p) for i, p in enumerate(pieces) if (t or "").strip()]
        got = chunking.char_windows(df, size=size, overlap=overlap)
        assert sorted(map(tuple, got.select("k", "total_chunks", "chunk_index", "text").collect())) == want
        back = {r.k: (r.complete, r.text) for r in chunking.reconstruct(got, key="k", overlap=overlap, total="total_chunks").collect()} if overlap else {}
        for k, (complete, t) in back.items():
            whole = len(re.findall(r"\w+", texts[k])) <= size
            assert complete and t == (texts[k] if whole else re.sub(r"^\W+|\W+$", "", texts[k]))


def test_index_and_cleaning_on_the_command_line(engine, folder, capsys):
    engine.add("kb", str(folder))
    said = lambda *a: (main(list(a), engine), json.loads(capsys.readouterr().out))[1]
    assert said("collection", "index", "kb") == {"indexed": "kb"}
    plain = said("search", "kb", "lighthouses", "--top-k", "1")["results"]
    assert said("search", "kb", "lighthouses", "--top-k", "1", "--probes", "9")["results"] == plain
    assert said("search", "kb", "lighthouses", "--top-k", "1", "--weights", "0.2", "0.8")["results"][0]["source_file"] == plain[0]["source_file"]
    (folder / "usage.txt").unlink()
    engine.sync("kb")
    assert len(engine.store("kb").segments("points")) == 2 and said("collection", "clean", "kb") == {"cleaned": "kb"}
    assert len(engine.store("kb").segments("points")) == 1 and len(engine.store("kb")._numbers()) == 1 and engine.store("kb").read("points").count() == 2
