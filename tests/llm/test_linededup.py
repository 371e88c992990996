import hashlib

import pytest
from conftest_llm import SMALL, documents, rows_of, rows_of_sql, view

from docwright.llm import linededup as L


def brute(rows):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans(L.UPPER, L.LOWER)
    first = {}
    for i, t, *_ in rows:
        i = L.LAST_ID if i is None else i
        for x in (t or "").split("\n"):
            k = x.strip(strip).translate(low)
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(strip).translate(low) for x in lines]
        kept = [x for x, k in zip(lines, keys) if len(k) < 10 or first[k] == (L.LAST_ID if i is None else i)]
        out.append((i, hashlib.sha256("\n".join(kept).encode()).hexdigest(), len(lines) - len(kept), len(lines)))
    return sorted(out, key=repr)


def test_matches_sql(spark):
    assert rows_of(L.op6_line_dedup(spark, SMALL)) == rows_of_sql(view(SMALL), L.OP6_SQL)


@pytest.mark.parametrize("hot", [False, True])
def test_odd_rows_hot_or_not(spark, odd_dir, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(L, "SAMPLE_MODULUS", 1)
        monkeypatch.setattr(L, "SAMPLE_LEAST", 2)
    assert rows_of(L.op6_line_dedup(spark, odd_dir)) == brute(documents(odd_dir))


def test_empty(spark, empty_dir):
    assert L.op6_line_dedup(spark, empty_dir).collect() == []


def test_keep_runs_and_extra_columns(spark, odd_dir):
    out = L.dedup_documents(spark.read.parquet(f"{odd_dir}/documents.parquet"))
    assert {"key", "size", "rest", "_kept", "_keep_runs"} <= set(out.columns)
    r = out.filter("text = 'shared line here\nshared line here'").first()
    assert r["_keep_runs"] == [0, 0] and r["_kept"] == "" and r["_n_dropped"] == 2


def test_native_plan(spark, odd_dir):
    plan = L.op6_line_dedup(spark, odd_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_reserved_names_pass(spark):
    rows = [(1, "a line of some length\nx", "p"), (2, "A line of some length \ny\n\nz", "q"), (None, None, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string").selectExpr("*", "_kept as _ord", "1 as _th", "2L as _drops", "text as _n_lines", "length(text) as n_chars")
    out = L.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["_kept"], r["_ord"], r["_th"], r["_drops"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (rows[0][1], "p", "p", 1, 2, 23), 2: ("y\n\nz", "q", "q", 1, 2, 4), None: (None, "r", "r", 1, 2, 0)}


def test_many_drops_of_a_long_text(spark):
    line = lambda i: f"repeated line number {i}"
    long = "\n".join(line(i) if i % 3 else f"own {i}" for i in range(60000))
    docs = spark.createDataFrame([(1, "\n".join(map(line, range(60000)))), (2, long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.dedup_documents(docs).collect()}
    assert got[1]["_n_dropped"] == 0 and got[2]["_n_dropped"] == 40000
    assert got[2]["_kept"] == "\n".join(f"own {i}" for i in range(0, 60000, 3)) and got[2]["_keep_runs"][:4] == [1, 0, 1, 0]
