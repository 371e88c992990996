import numpy as np
import pytest

from docwright.operators import neighbours as N, retrieval


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((40, 24)) * 3
    x = centres[r.integers(0, 40, 4000)] + r.standard_normal((4000, 24))
    x[100:140] = x[100]  # a group of copies
    return spark.createDataFrame([(int(i) if i != 7 else None, v.tolist()) for i, v in enumerate(x)] + [(9999, None), (2**53 + 1, x[5].tolist())], "id long, embedding array<double>")


def test_recall_and_the_exact_way(spark, rows, tmp_path):
    folder = str(tmp_path)
    N.build(rows, folder)
    queries = rows.filter("id % 50 = 0").selectExpr("id as query_id", "embedding")
    want = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in retrieval.nearest(rows, queries, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in N.search(spark, folder, queries, 10).collect()}
    assert len(near & {(q, i) for (q, _), (i, _) in want.items()}) / len(want) >= 0.9
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in N.search(spark, folder, queries, 10, probes=2, exact=True, most_queries=30).collect()}
    assert got == want


def test_few_rows_and_none(spark, rows, tmp_path):
    N.build(rows.limit(3), str(tmp_path / "a"))
    queries = rows.limit(2).selectExpr("id as query_id", "embedding")
    assert N.search(spark, str(tmp_path / "a"), queries, 10).count() == 6
    N.build(rows.limit(0), str(tmp_path / "b"))
    assert N.search(spark, str(tmp_path / "b"), queries, 10).collect() == []


def test_only_probed_cells_are_read(spark, rows, tmp_path):
    N.build(rows, str(tmp_path))
    plan = N.current(spark, f"{tmp_path}/rows").filter(N.F.col("cell").isin(1, 2)).select("id", "code")._jdf.queryExecution().toString()
    assert "In(cell, [1,2])" in plan and "embedding" not in plan.split("ReadSchema")[-1]


def test_an_index_reads_more_until_it_finds_enough(spark, tmp_path):
    """Vectors without clusters, whose few and rough codes put neighbours far behind the first hundred."""
    x = np.random.default_rng(4).standard_normal((6000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    N.build(rows, str(tmp_path), parts=2, codes=4)
    queries = rows.filter("id % 60 = 0").selectExpr("id as query_id", "embedding")
    want = {(r["query_id"], r["id"]) for r in retrieval.nearest(rows, queries, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in N.search(spark, str(tmp_path), queries, 10).collect()}
    assert len(near & want) >= 0.9 * len(want)
