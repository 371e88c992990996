import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwright.functions import text as T
from docwright.operators import chunking, citations, evaluation, retrieval, tables
from docwright.sources import files
from docwright.streaming import metrics


@pytest.mark.parametrize("a,b,n,first", [
    ([("c1", 1), ("c2", 2)], [("c2", 1), ("c3", 2)], 3, "c2"),
    ([("c1", 1)], [("c2", 1), ("c3", 2), ("c4", 3)], 4, "c1"),
    ([("c1", 1), ("c2", 2)], [("c3", 1), ("c4", 2)], 4, "c1"),
    ([("c1", 1), (None, 2)], [("c2", 1)], 2, "c1"),
])
def test_fusion(spark, a, b, n, first):
    make = lambda rows: spark.createDataFrame([(1, i, r) for i, r in rows], "query_id int, id string, rank int")
    got = retrieval.fuse(make(a), make(b), 10).orderBy("rank").collect()
    assert len(got) == n and got[0]["id"] == first


def test_nearest_in_blocks_of_queries_with_groups_of_copies(spark):
    r = np.random.default_rng(3)
    few = r.standard_normal((4, 5))
    rows = [(i, few[i % 4].tolist()) for i in range(200)][::-1]  # 50 copies each, the largest ids first
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    asked = [(100 + k, r.standard_normal(5).tolist()) for k in range(7)]
    got = retrieval.nearest(vectors, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 3, most_queries=2)
    want = set()
    for k, q in asked:
        near = sorted((round(float(np.linalg.norm(np.array(v) - q)), 6), i) for i, v in rows)[:3]
        want |= {(k, i, d, n + 1) for n, (d, i) in enumerate(near)}
    assert {(x["query_id"], x["id"], x["distance"], x["rank"]) for x in got.collect()} == want


def test_diversified_matches_greedy_loop(spark):
    r = np.random.default_rng(0)
    x, q = r.standard_normal((8, 4)), r.standard_normal(4)
    rows = [(1, i, q.tolist(), v.tolist()) for i, v in enumerate(x)] + [(1, 99, q.tolist(), None)]
    got = [t["id"] for t in retrieval.diversified(spark.createDataFrame(rows, "query_id long, id long, query_embedding array<double>, embedding array<double>"), 5).orderBy("rank").collect()]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, want = n @ (q / np.linalg.norm(q)), []
    while len(want) < 5:
        value = {i: 0.7 * s[i] - 0.3 * max((n[i] @ n[j] for j in want), default=0) for i in range(8) if i not in want}
        want.append(max(value, key=value.get))
    assert got == want


def test_adaptive_cuts():
    text = ". ".join(f"Sentence number {i} goes on" for i in range(200))
    cuts = chunking.cut_points(text, 1000, 300)
    assert all(text.startswith(c, a) for a, c in cuts) and cuts[-1][0] + len(cuts[-1][1]) == len(text)
    assert all(b <= a + len(c) + 2 for (a, c), (b, _) in zip(cuts, cuts[1:])) and all(len(c) <= 1202 for _, c in cuts)
    assert chunking.cut_points("x" * 3000, 1000, 999)[-1][0] < 3000 and chunking.cut_points("", 10, 1) == []


def test_citations(spark):
    text = "A fact. [Source: w.pdf | Page 1, Para 2 | \"Def\"] More. [Source: c.pdf | Page 9] [[@Source-3]]"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [tuple(r)[2:5] for r in citations.citations(df, "id", "t").orderBy("position").collect()]
    assert got == [("w.pdf", 1, 2), ("c.pdf", 9, None)]
    assert df.select(citations.inline_sources(F.col("t"))).first()[0] == [3]
    known = spark.createDataFrame([("w.pdf", 1, 2)], "file_name string, page_number int, paragraph_number int")
    assert citations.verified(citations.citations(df, "id", "t"), known).first()[1:] == (2, 1, False)


def test_evaluation(spark):
    df = spark.createDataFrame([(["a", "b", "x"], ["a", "b", "c"]), ([], []), (["a"], [])], "r array<string>, t array<string>")
    s = evaluation.citation_scores(F.col("r"), F.col("t"))
    got = df.select(evaluation.recall_at(F.col("r"), F.col("t"), 10), s["accuracy"], s["precision"], s["recall"]).collect()
    assert [tuple(round(v, 3) for v in x) for x in got] == [(0.667, 0, 0.667, 0.667), (1, 1, 1, 1), (1, 0, 0, 1)]
    ten = spark.createDataFrame([(float(v),) for v in range(10, 101, 10)], "v double")
    assert ten.agg(*tables.nearest_rank("v", 0.5)).first()[0] == 60.0


def test_first_date(spark):
    rows = [("on 2021-03-04", "2021-03-04"), ("5/6/2020", "2020-06-05"), ("7.8.2019", "2019-08-07"), ("1 May 2018", "2018-05-01"), ("none", None), ("31/02/2020", None)]
    df = spark.createDataFrame(rows, "t string, d string").withColumn("g", T.first_date(F.col("t")).cast("string"))
    assert all(r["d"] == r["g"] for r in df.collect())


def test_rekey_and_induced(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "s int, t int")
    m = spark.createDataFrame([(2, 1)], "old int, new int")
    assert sorted(map(tuple, tables.rekey(e, m, "s", "t").collect())) == [(1, 3), (3, 4)]
    assert tables.induced(e, spark.createDataFrame([(1,), (2,)], "k int"), "s", "t", "k").collect()[0][:] == (1, 2)


def test_file_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.eml").write_bytes(b"From: a@b.c\nTo: d@e.f\nSubject: Hi\nContent-Type: text/html\n\n<p>Body <b>text</b></p>")
    (tmp_path / "sub" / "n.txt").write_text("plain")
    (tmp_path / "x.bin").write_bytes(b"no")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    got = {r["file_name"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.eml", "n.txt", "bad.docx", "w.docx"}
    assert got["a.eml"]["text"].strip() == "Body text" and got["a.eml"]["metadata"]["Subject"] == "Hi"
    assert got["w.docx"]["text"] == "One\n\na | b" and got["bad.docx"]["error"] and got["n.txt"]["text"] == "plain"


def test_metrics_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda k, n: (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"ts": f"2024-01-0{1 + i % 5}T00:00:00", "model": "m", "query_type": "q", "tokens": 10, "ms": 5.0}) + "\n" for i in range(n)))
    seen = []
    for k, n in ((0, 4), (1, 12)):
        put(k, n)
        metrics.append(metrics.read_metrics(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
        metrics.when_enough(metrics.read_metrics(spark, str(tmp_path / "in")), lambda b, i: seen.append(b.count()), 10, str(tmp_path / "p"), str(tmp_path / "c2")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "out"))
    assert log.count() == 16 and seen == [16]
    assert sum(r["n"] for r in metrics.rollup(log).collect()) == 16
