import hashlib

import corpus_pipeline as P
import pyarrow as pa
from conftest_llm import SMALL

from docwright import session
from docwright.llm import bpe, linededup, ngramjoin


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "line_dedup", "near_copies", "mixing", "bpe"]
    first = P.quality_filter(spark, docs, SMALL).cache()
    assert 0.5 * docs.count() < first.count() < docs.count() and first.columns == docs.columns
    lines = P.line_dedup(spark, first, SMALL).cache()
    assert lines.count() == first.count() and lines.columns == docs.columns
    seen = {}
    for r in lines.collect():
        assert r["n_chars"] == len(r["text"] or "")
        for x in (r["text"] or "").split("\n"):
            k = x.strip(linededup.BLANKS).lower()
            if len(k) >= 10:
                assert seen.setdefault(k, r["doc_id"]) == r["doc_id"]
    near = P.near_copies(spark, lines, SMALL).cache()
    groups = ngramjoin.near_groups(near).collect()
    assert near.columns == docs.columns and len({r["component"] for r in groups}) == len(groups)
    mixed = P.mixture(spark, near, SMALL).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    t = bpe.tokenizer(bpe.vocabulary())
    want = sorted((r["doc_id"], hashlib.sha256(t.encode_batch([r["text"] or ""])[0].encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in P.tokens(spark, mixed, SMALL).collect()) == want


def test_run_odd_and_empty(spark, odd_dir, empty_dir):
    assert P.run(spark, odd_dir).count() > 0
    assert P.run(spark, empty_dir).collect() == []


def test_stages_take_texts_in_small_batches(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    sizes = lambda: [r["n"] for r in spark.range(0, 6000, 1, 1).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for _, make in P.STAGES:
            for k in keys:
                spark.conf.unset(k)
            make(spark, docs, SMALL)
            assert max(sizes()) <= session.BATCH_ROWS
        spark.conf.set(keys[0], 2500)  # a session's own number holds
        P.tokens(spark, docs, SMALL)
        assert max(sizes()) == 2500
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
