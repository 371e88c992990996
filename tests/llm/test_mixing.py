from collections import defaultdict

import pytest
from conftest_llm import SMALL, rows_of, rows_of_sql, view

from docwright.llm import mixing as X


def close(a, b):
    return len(a) == len(b) and all(x == y or all(p == q or isinstance(p, float) and abs(p - q) < 1e-6 * max(1, abs(q)) for p, q in zip(x, y)) for x, y in zip(a, b))


@pytest.mark.parametrize("where", ["small", "odd"])
def test_matches_sql(spark, odd_dir, where):
    d = SMALL if where == "small" else odd_dir
    assert close(rows_of(X.op1_mixing(spark, d)), rows_of_sql(view(d), X.OP1_SQL))


def test_targets_and_budget(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 30), ("zero", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in X.targets(sizes).collect()}
    assert abs(sum(got.values()) - 1540) < 1e-6 and got["a"] == 30 and got["zero"] == 0 and got[None] == 90
    assert abs(got["b"] / got["c"] - 2.0) < 1e-9
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in X.op1_mixing(spark, SMALL).collect():
        x = by[r["target"]]
        x[0] += r["taken"]; x[1] = r["target"]; x[2] = max(x[2], r["size"])  # noqa: E702
        assert r["taken"] <= 3 * r["size"]


def test_mix_repeats_rows_and_keeps_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    mixed = X.mix(docs)
    assert mixed.columns == docs.columns
    plan = X.op1_mixing(spark, odd_dir).collect()
    assert sum(r["taken"] for r in plan) == mixed.select(X.words(mixed["text"]).alias("w")).groupBy().sum("w").first()[0]


def test_empty(spark, empty_dir):
    assert X.op1_mixing(spark, empty_dir).collect() == []
    assert X.mix(spark.read.parquet(f"{empty_dir}/documents.parquet")).collect() == []


def test_given_weights_and_reserved_names(spark):
    from pyspark.sql import functions as F

    docs = spark.range(2000).selectExpr("id as doc_id", "'one two three four' as text", "if(id % 2 = 0, 'a', 'b') as source", "id % 4 < 2 as _mix_cut", "1 as _Mix_turn")
    out = X.mix(docs, F.when(F.col("_mix_cut"), 0.9).otherwise(0.1))
    assert out.columns == docs.columns
    taken = [r["_mix_cut"] for r in out.filter("source = 'b'").collect()]
    assert 0.75 < sum(taken) / len(taken)  # what weighs nine times as much is taken first


def test_equal_rows_at_the_cut(spark, tmp_path):
    """Sources of equal rows: each comes within a document of its target, by the query as by the SQL."""
    ten = "w " * 10
    rows = [(None, ten, "a", None)] * 1000 + [(7, ten, "b", 1)] * 1000 + [(i, ten, "c", 1) for i in range(700)] + [(2**53 + 1, ten, "c", 2)] * 300 + [(2**53 + 2, ten, None, 2)] * 200
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string, key int").write.parquet(f"{d}/documents.parquet")
    got = rows_of(X.op1_mixing(spark, d))
    assert close(got, rows_of_sql(view(d), X.OP1_SQL))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    target = {r["target"]: 0 for r in X.op1_mixing(spark, d).collect()}
    plan = X.mix_plan(docs, X.quality_weight(docs["text"]))[1].collect()
    assert len(target) > 1
    by = defaultdict(int)
    for r in X.mix(docs).collect():
        by[r["source"]] += 10
    assert all(abs(by[r["source"]] - r["target"]) <= 10 for r in plan) and any(r["target"] % r["source_size"] for r in plan)
    again = rows_of(X.op1_mixing(spark, d))
    assert again == got
