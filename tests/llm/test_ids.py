"""Long ids beside nulls in one batch come back as they are, in every operator that passes rows through Python."""

import pytest
from conftest_llm import SMALL

from docwright.llm import bpe, lexical, periodic, quality, tokencount, toxicity, webp

IDS = [None, 2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1]


@pytest.fixture(scope="module")
def big_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("big"))
    rows = [(i, f"some words of text {k}", "en", None) for k, i in enumerate(IDS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, "some words") for i in IDS], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("query", [bpe.op2_bpe, webp.op3_media, quality.op4_quality, toxicity.op9_toxicity, periodic.op12_periodic_runs, tokencount.op13_token_counts])
def test_ids_are_exact(spark, big_dir, query):
    assert {r["doc_id"] for r in query(spark, big_dir).collect()} == set(IDS)


def test_search_ids(spark, big_dir):
    got = lexical.op11_ranked_search(spark, big_dir).collect()
    assert {r["doc_id"] for r in got} == set(IDS) == {r["item_id"] for r in got}


def test_carried_columns(spark, big_dir):
    docs = spark.read.parquet(f"{big_dir}/documents.parquet").selectExpr("*", "doc_id as _ids", "doc_id as _Tokens", "doc_id as _score", "doc_id as _text")
    out = bpe.encode(docs, bpe.vocabulary())
    assert out.columns[:7] == ["doc_id", "lang", "source", "_ids", "_Tokens", "_score", "_text"] and len(set(c.lower() for c in out.columns)) == 10
    assert {r["_ids"] for r in out.collect()} == set(IDS)
    labels = spark.read.parquet(f"{big_dir}/labels.parquet")
    kept = toxicity.toxicity_scores(docs, labels, ["doc_id", "_score", "_text"], score="made")
    assert {(r["_score"], r["_text"]) for r in kept.collect()} == {(i, i) for i in IDS}
