"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestar.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert canonical(map(tuple, got.select(*columns).collect())) == canonical([tuple(r[k] for k in order) for r in want.fetchall()])


def test_quantised_query_recall(spark):
    """With an eighth of the cells left out, on vectors without clusters; scores are exact."""
    rows = lambda name: {(r.query_id, r.id): r.score for r in catalogue.QUERIES[name](spark, SF).collect()}
    exact, found = rows("dense_topk_all"), rows("dense_topk_codes")
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"dense_topk_codes"}
    assert len(set(exact) & set(found)) >= 0.9 * len(exact)
    assert all(abs(exact[k] - found[k]) < 2e-6 for k in set(exact) & set(found))


def test_whole_tables_are_searched(spark, tmp_path):
    """A document without a vector, an item without one, and a vector without a document are found."""
    spark.createDataFrame([(0, "alpha beta", "s"), (1, "gamma", "s"), (9, "gamma delta", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [1.0, 0.1])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "delta"), (8, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = lambda name: sorted((r.query_id, r.id) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
    assert found("sparse_topk_all") == [(0, 9), (8, 1), (8, 9)]
    assert found("dense_topk_all") == [(0, 0), (0, 1), (0, 7)]


def test_entry_points_without_the_corpus_subpackage(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("lodestar.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "lodestar.llm", None)
    try:
        alone = importlib.reload(__spark_entry__)
        assert set(alone.queries()) == set(catalogue.QUERIES) and set(alone.oracle_sql()) == set(catalogue.ORACLE_SQL)
        assert alone.entry(spark).count() >= 0
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
