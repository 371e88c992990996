import numpy as np
import pytest
from conftest_llm import view

from docwright.llm import quality as Q, toxicity as X

MEDIUM = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in X.op9_toxicity(spark, MEDIUM).collect()}
    labels = view(MEDIUM, "labels").execute("select doc_id, toxic from labels where toxic is not null").fetchall()
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert held and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert sum(p for p, y in held if y == 1) / sum(y == 1 for _, y in held) > 0.6
    assert sum(p > y for p, y in held) / sum(y == 0 for _, y in held) < 0.05


def test_toxicity_thresholds_by_language():
    """Enough labelled rows in each language: each gets a threshold of its own, and rows not learnt from are told apart."""
    import pandas as pd

    r = np.random.default_rng(5)
    speak = {"en": (["house", "road", "green", "calm"], ["vile", "slur"]), "de": (["straße", "grün", "müde", "schön"], ["übel", "häßlich"]), "fr": (["été", "très", "forêt", "déjà"], ["méchant", "sâle"])}
    rows = []
    for lang, (plain, bad) in speak.items():
        for k in range(400):
            toxic = int(k % 4 == 0)
            words = list(r.choice(plain, 12)) + (list(r.choice(bad, 2)) if toxic else [])
            r.shuffle(words)
            rows.append((" ".join(words), toxic, lang))
    apart = [(k // 4) % 3 == 0 for k in range(len(rows))]
    frame = pd.DataFrame({"text": [t for t, _, _ in rows], "_y": [y for _, y, _ in rows], "_part": [0 if a else 1 for a in apart]})
    net = X.fit(frame)
    assert {lang for lang in net.shift if lang} == set(speak)
    scores = X.Scorer(net).score([t for t, _, _ in rows])
    for lang in speak:
        mine = [(s >= X.SHOWN, y) for s, (_, y, g), a in zip(scores, rows, apart) if g == lang and a]
        assert sum(p for p, y in mine if y) / sum(y for _, y in mine) > 0.9 and not sum(p for p, y in mine if not y) / len(mine) > 0.05


def test_what_a_view_is_sure_of():
    margins = np.array([*np.linspace(-3, -2, 50), *np.linspace(-1, 1, 60), *np.linspace(2, 3, 50)])
    z = np.array([0] * 50 + [0, 1] * 30 + [1] * 50)
    low, high = Q.sure(margins, z)
    assert -2.1 < low < -0.9 and 0.9 < high < 2.1
    assert Q.sure(np.arange(100.0), np.arange(100) % 2) == (-np.inf, np.inf) and Q.sure(np.zeros(0), np.zeros(0)) == (-np.inf, np.inf)


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in Q.op4_quality(spark, MEDIUM).collect()}
    labels = view(MEDIUM, "labels").execute("select doc_id, quality from labels where quality is not null").fetchall()
    held = [(got[i]["keep"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(k == 1 for k, y in held if y == 1) / sum(y == 1 for _, y in held) > 0.95
    assert sum(k == 0 for k, y in held if y == 0) / sum(y == 0 for _, y in held) > 0.7


def test_confident_sums_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    r = np.random.default_rng(0)
    fitted = [((20 * r.standard_normal(n)).astype(np.float32), np.zeros(1, np.float32), -2.0, 1.5) for n in Q.WIDTHS]
    learnt = {rows[0]["doc_id"], rows[3]["doc_id"]}
    want = [np.zeros((Q.CELLS, 2, n + 1), np.int64) for n in Q.WIDTHS]
    for x in rows:
        if x["doc_id"] not in learnt:
            f = Q.content(x["text"] or ""), Q.metadata(x["text"] or "", x["lang"], x["source"])
            cell = Q.zlib.crc32(f"{x['source']}|{x['lang']}".encode()) % Q.CELLS
            for v in (0, 1):
                m = float((f[1 - v] @ fitted[1 - v][0] + fitted[1 - v][1])[0])
                if m >= 1.5 or m <= -2:
                    want[v][cell, int(m >= 1.5)] += np.append(np.rint(f[v] * Q.UNIT).astype(np.int64), 1)
    got = [np.zeros_like(w) for w in want]
    for t in Q.confident_sums(docs, fitted, learnt).itertuples():
        got[t.view][t.cell, t.label, t.place] = t.total  # place -1 is the last
    assert all((g == w).all() for g, w in zip(got, want)) and got[0].any() and got[1].any()


def test_reserved_names_and_large_ids_pass(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").selectExpr("*", "doc_id as _score", "9007199254740993L + doc_id as _kept", "text as _text_in")
    out = Q.reject_low_quality(docs, spark.read.parquet(f"{odd_dir}/labels.parquet"))
    assert out.columns == docs.columns
    assert all(r["doc_id"] is None or r["_kept"] == 9007199254740993 + r["doc_id"] for r in out.collect())


@pytest.mark.parametrize("query", [X.op9_toxicity, Q.op4_quality])
def test_odd_rows_and_empty(spark, odd_dir, empty_dir, query):
    n = spark.read.parquet(f"{odd_dir}/documents.parquet").count()
    got = query(spark, odd_dir).collect()
    assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
    assert query(spark, empty_dir).collect() == []


def test_reject_keeps_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = Q.reject_low_quality(docs, spark.read.parquet(f"{odd_dir}/labels.parquet"))
    assert out.columns == docs.columns and out.count() <= docs.count()


def test_blocks_of_a_long_text_score_as_the_whole(monkeypatch):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in r.integers(0, 50, 400)]
    net = X.Net()
    net.shift[""] = 0.0
    whole = X.Scorer(net).score([" ".join(words), "", "one"])
    monkeypatch.setattr(X, "BLOCK_WORDS", 20)
    assert np.allclose(X.Scorer(net).score([" ".join(words), "", "one"]), whole, atol=1e-6)
    monkeypatch.setattr(X, "CACHE_WORDS", 30)
    assert np.allclose(X.Scorer(net).score([" ".join(words), "", "one"]), whole, atol=1e-6)


def test_scoring_matches_training_features():
    net = X.Net()
    texts = ["a b c d", "", "x y"]
    lists = [np.array([X.word_rows(w) for w in X.tokens(t)], np.int64).reshape(-1, 3) for t in texts]
    assert np.allclose(X.Scorer(net).pooled([X.tokens(t) for t in texts]), net.features(*X.packed(lists))[2], atol=1e-5)
