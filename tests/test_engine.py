import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwright import config, jobs
from docwright.functions import text as T
from docwright.operators import catalogs, citations, parties, prompts, retrieval, search, segments, store, tables
from docwright.sources import files
from docwright.streaming import metrics


def test_percentiles_match_sorting(spark):
    r = random.Random(2)
    rows = [(g, r.choice([1.5, 2.0, r.random()])) for g in "aab" for _ in range(3000)] + [("c", 7.0), ("d", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: (x["p50"], x["p95"], x["p99"]) for x in tables.percentiles(df, "g", "v", 0.5, 0.95, 0.99).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = tuple(v[min(int(len(v) * p), len(v) - 1)] for p in (0.5, 0.95, 0.99))
    assert got == want


@pytest.mark.parametrize("expression,want", [
    ("red", {1, 2}), ("red fox", {1}), ("red OR hen", {1, 2, 3}), ("red NOT fox", {2}), ('"red fox"', {1}), ("fo*", {1}), ("(red OR blue) AND hen", {3}), ('"blue h*"', set()), ("none", set()), ("", set()),
    ("red AND", set()), ("(red", set()),
])
def test_match_grammar(spark, expression, want):
    docs = spark.createDataFrame([(1, "The RED fox"), (2, "a fire, red"), (3, "blue hen"), (4, None)], "id int, t string")
    assert {r["id"] for r in search.match_search(docs, F.col("t"), expression).collect()} == want


def _chunks(spark):
    rows = [("1", 1, "witness.pdf", "John Smith said that the delivery was late on Monday", "witness_statement"), ("2", 2, "witness.pdf", "The meeting was on 25 December 2023", "witness_statement"), ("3", 3, "contract.pdf", "The agreement sets a delivery term of ten days", "contract")]
    return spark.createDataFrame([(i, f, t, k) for _, i, f, t, k in rows], "id long, file_name string, text string, document_type string")


def test_hybrid_by_name_concept_and_filter(spark):
    chunks, cols = _chunks(spark), ["file_name", "text", "document_type"]
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id long, text string")
    assert search.retrieve(chunks, ask("John Smith"), cols).orderBy("rank").first()["id"] == 1
    assert search.retrieve(chunks, ask("December 2023"), cols).orderBy("rank").first()["id"] == 2
    only = search.retrieve(chunks, ask("delivery"), cols, where=search.selection(document_type="contract"))
    assert [r["id"] for r in only.collect()] == [3]
    skip = search.retrieve(chunks, ask("delivery term"), cols, search.Settings(skip_rerank=True, final=2)).orderBy("rank").collect()
    assert len(skip) == 2 and all(r["score"] == r["rrf_score"] for r in skip)
    strict = search.retrieve(chunks, ask("delivery zzz yyy xxx www vvv uuu ttt"), cols, search.Settings(strict=True)).collect()
    loose = search.retrieve(chunks, ask("delivery zzz yyy xxx www vvv uuu ttt"), cols).collect()
    assert len(strict) == 0 and len(loose) == 3
    diverse = search.retrieve(chunks, ask("delivery late"), cols, search.Settings(balance=0.5, final=2)).collect()
    assert len(diverse) == 2 and {r["rank"] for r in diverse} == {1, 2}
    scored = search.retrieve(chunks, ask("delivery"), cols, scorer=lambda q, t: np.array([len(x) for x in t], float)).orderBy("rank").first()
    assert scored["score"] == max(len(r["text"]) for r in chunks.collect())


def test_embedder_and_vectors(spark):
    x = search.HashingEmbedder()(["one two", "", "two one"])
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 1]) and np.allclose(x[0], x[2])
    rows = spark.createDataFrame([(1, "one"), (2, " "), (3, None)], "id long, t string")
    assert [r["id"] for r in search.embedded(rows, "id", "t").collect()] == [1]
    with pytest.raises(ValueError):
        search.with_vectors(rows.withColumnRenamed("t", "text"), search.embedded(rows, "id", "t"))
    states, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert np.allclose(search.pooled(states, mask)[0] * np.linalg.norm([2, 3, 4, 5]), [2, 3, 4, 5])


def test_nearest_without_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in retrieval.nearest(v, q, 3).collect()] == [(1, 1)]
    none = spark.createDataFrame([(1, 2, [1.0], None)], "query_id long, id long, query_embedding array<double>, embedding array<double>")
    assert retrieval.diversified(none, 3).collect() == []


def test_grading_keeps_a_batch_it_cannot_read(spark):
    rows = spark.createDataFrame([(i, "q", f"t{i}") for i in range(7)], "id int, query string, text string").coalesce(1)
    kept = search.graded(rows, lambda q, t: [x != "t1" for x in t] if len(t) == 5 else [True], 5)
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 3, 4, 5, 6]


def _verify(spark, text, threshold=0.7):
    chunks = spark.createDataFrame([("w1", "witness.pdf", 1, 1, 0.85, 1), ("w2", "witness.pdf", 1, 2, 0.75, 2), ("c1", "contract.pdf", 5, 3, 0.9, 3), ("old", "low.pdf", 2, None, 0.9, 4), ("new", "low.pdf", 2, None, 0.3, 5)],
                                   "chunk_id string, file_name string, page_number int, paragraph_number int, score double, position int")
    return tuple(citations.verify(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", chunks, threshold).first())[1:]


@pytest.mark.parametrize("text,want", [
    ("It was late [Source: witness.pdf | Page 1, Para 1]. So it says [source:contract.pdf|Page 5, Para 3 | \"Definitions\"].", (2, 0, 0, True)),
    ("A fact [Source: unknown.pdf | Page 1].", (1, 1, 0, False)), ("A fact [Source: witness.pdf | Page 9, Para 1].", (1, 1, 0, False)),
    ("A fact [Source: witness.pdf | Page 1, Para 1]. And a bare sentence that stands for itself.", (1, 0, 1, False)),
    ("This is not found in provided documents.", (0, 0, 0, True)), ("Low [Source: low.pdf | Page 2].", (1, 0, 0, True)), ("", (0, 0, 0, True)), (None, (0, 0, 0, True)),
])
def test_citations_verified(spark, text, want):
    assert _verify(spark, text) == want


def test_citation_of_a_low_chunk_is_missing(spark):
    assert _verify(spark, "A fact [Source: witness.pdf | Page 1, Para 2].", 0.8) == (1, 1, 0, False)


def test_spans(spark):
    r = random.Random(6)
    rows = [("".join(r.choice("ab1 ") for _ in range(30)),) for _ in range(50)] + [("",), ("1",), ("11 1",)]
    got = spark.createDataFrame(rows, "t string").select("t", parties.spans(F.col("t"), "1+").alias("s")).collect()
    assert all([(x["start"], x["found"]) for x in g["s"]] == [(m.start(), m[0]) for m in re.finditer("1+", g["t"])] for g in got)


def test_stored_versions_and_queue(spark, tmp_path):
    d = str(tmp_path / "t")
    store.upsert_stored(spark, d, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    store.upsert_stored(spark, d, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, store.current(spark, d).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert store.delete_stored(spark, d, spark.createDataFrame([(1,), (9,)], "k int"), "k") == 1
    store.compact(spark, d, 1)
    assert store.current(spark, d).count() == 2 and len(list((tmp_path / "t").glob("v-*"))) == 2
    store.reset(spark, d)
    assert not store.exists(spark, d)
    q = spark.createDataFrame([("x", "pending", 1), ("y", "accepted", 1)], "document_id string, status string, n int")
    q = store.queued(q, spark.createDataFrame([("x", 2), ("y", 2)], "document_id string, n int"))
    assert sorted(map(tuple, store.decided(q, ["x"], True).collect())) == [("x", "accepted", 2), ("y", "accepted", 1), ("y", "pending", 2)]
    assert [r["document_id"] for r in store.pending(q, "document_id").collect()] == ["x", "y"]


def test_matters_copied(spark, tmp_path):
    t = {"c": spark.createDataFrame([("m1", 1), ("m2", 2)], "matter_id string, x int")}
    store.copy_matter(t, "m1", str(tmp_path))
    assert sorted(map(tuple, store.imported(spark, t, str(tmp_path), "m3")["c"].collect())) == [("m1", 1), ("m2", 2), ("m3", 1)]


def test_upserting_stream_and_release_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c")]]):
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in rows))
        metrics.upsert_stream(metrics.read_metrics(spark, str(tmp_path / "in"), "k int, v string"), str(tmp_path / "t"), "k", str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, segments.read(spark, str(tmp_path / "t")).collect())) == [(1, "a"), (2, "c")]
    done = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 1)], "g string, n int")
    assert sorted(map(tuple, metrics.in_order(done, "g", "n").collect())) == [("a", 0), ("a", 1)]


def test_settings_merge(tmp_path):
    base = {"a": {"x": 1, "y": 2}, "b": [1]}
    assert config.merged(base, {"a": {"y": 3}, "b": [2], "c": None}) == {"a": {"x": 1, "y": 3}, "b": [2], "c": None} and base["a"]["y"] == 2
    (tmp_path / "s.json").write_text('{"a": {"x": 5}}')
    assert config.loaded(str(tmp_path / "s.json"), base)["a"] == {"x": 5, "y": 2} and config.loaded(str(tmp_path / "no.json"), base) == base


def test_generated_answers_and_jobs(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "two")], "id int, p string").coalesce(1)
    said = jobs.parsed(jobs.generated(rows, "p", lambda ps: ["```json\n{\"n\": 1}\n```" if p == "one" else "no" for p in ps]), "answer", "n int")
    assert {r["id"]: r["parsed"] and r["parsed"]["n"] for r in said.collect()} == {1: 1, 2: None}
    assert [r["answer"] for r in jobs.generated(rows, "p", lambda ps: 1 / 0).collect()] == [None, None]
    tries = []

    def slow(ps):
        tries.append(1)
        return ['{"n": 2}' if len(tries) > 1 else "no"] * len(ps)

    assert [r["parsed"]["n"] for r in jobs.answered(rows, "p", slow, "n int").collect()] == [2, 2]
    jobs.job("double")(lambda df: df.union(df))
    assert jobs.run_job("double", rows).count() == 4
    with pytest.raises(KeyError):
        jobs.run_job("nothing")
    assert jobs.register_functions(spark) and spark.sql("select document_key('a'), round(name_similarity('Acme', 'ACME'), 1)").first()[1] == 1.0


def test_more_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1}\n\n{"a": broken\n')
    got = files.json_lines(spark, str(tmp_path / "l.json"), "a int", "bad").cache()
    assert got.filter("a = 1").count() == 1 and got.filter("bad is not null").count() == 1 and sum(r["broken"] is not None for r in files.json_lines(spark, str(tmp_path / "l.json"), "a int").collect()) == 1
    (tmp_path / "e.json").write_text(json.dumps([{"query_id": "q", "query": "x"}]))
    r = files.evaluation_set(spark, str(tmp_path / "e.json")).first()
    assert r["ground_truth_chunks"] == [] and r["should_refuse"] is False
    chunks, asked = files.synthetic_evaluation(spark)
    assert chunks.count() == 8 and asked.count() == 5
    files.register(".xyz", lambda raw: (raw.decode().upper(), {}))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.xyz").write_text("up")
    assert files.documents(spark, str(tmp_path / "d")).first()["text"] == "UP"
    del files.PARSERS["xyz"]


def test_first_available_and_sizes(spark):
    have = spark.createDataFrame([("b",), ("c",)], "name string")
    assert prompts.first_available(["a", "c", "b"], have) == "c" and prompts.first_available(["z"], have) is None


def test_panels(spark):
    n = spark.createDataFrame([("1", "Acme", "party", {"a": "x"}), ("2", "Bo", "event", {"d": "ACME"}), ("3", "C", "party", None)], "node_id string, label string, node_type string, metadata map<string,string>")
    assert [r["node_id"] for r in catalogs.entity_panel(n, "acme").collect()] == ["1", "2"] and [r["node_id"] for r in catalogs.entity_panel(n, "", "party").collect()] == ["1", "3"]


BIG = [None, 2**53 + 1, 2**53 + 3, -(2**63)]


def test_long_ids_beside_nulls(spark):
    rows = spark.createDataFrame([(i, [float(k), 1.0], "red fox", "q") for k, i in enumerate(BIG)], "id long, embedding array<double>, text string, query string").coalesce(1)
    ids = lambda df, c="id": {r[c] for r in df.collect()}
    vectors = spark.createDataFrame([(2**53 + 1, [0.0, 1.0]), (None, [1.0, 1.0])], "query_id long, embedding array<double>")
    near = retrieval.nearest(rows.select("id", "embedding"), vectors, 4)
    assert ids(near) == set(BIG) and ids(near, "query_id") == {2**53 + 1, None}
    asked = spark.createDataFrame([(2**53 + 1, "fox"), (None, "red")], "query_id long, text string")
    found = retrieval.bm25_search(rows, "id", ["text"], asked, 4)
    assert ids(found) == set(BIG) and ids(found, "query_id") == {2**53 + 1, None}
    assert [r["id"] for r in retrieval.bm25_search(rows, "id", ["text"], asked, 2).filter("query_id is not null").orderBy("rank").collect()] == [None, -(2**63)]
    assert ids(search.embedded(rows, "id", "text")) == set(BIG)
    ranked = rows.select(F.lit(1).alias("query_id"), "id", "query", "text", F.lit(1).alias("rank"))
    assert ids(search.reranked(ranked)) == set(BIG)
    assert ids(search.graded(rows, lambda q, t: [True] * len(t))) == set(BIG)
    assert ids(jobs.generated(rows, "text", lambda ps: ps)) == set(BIG)


def test_table_functions(spark):
    assert "text_matches" in jobs.register_functions(spark)
    text = "On 5 May we met. Then 12 June? yes"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT id, m.* FROM some_texts, LATERAL text_matches(t, '[0-9]+', 3) m").collect()
    assert [tuple(r) for r in got] == [(1, 0, 3, 4, "5", "On 5 Ma"), (1, 1, 22, 24, "12", "en 12 Ju")]
    assert [r["sentence"] for r in spark.sql("SELECT s.* FROM some_texts, LATERAL text_sentences(t) s").collect()] == ["On 5 May we met.", "Then 12 June?", "yes"]
    cut = spark.sql("SELECT c.* FROM some_texts, LATERAL text_chunks(t, 20, 5) c").collect()
    assert all(text[r["start"] : r["stop"]] == r["chunk"] for r in cut) and len(cut) > 1
    row = spark.sql("SELECT document_key('a'), word_overlap('red fox', 'Red hen'), round(name_similarity('Acme', 'ACME'), 1)").first()
    assert row[0] == "doc_0cc175b9" and row[1] == 0.5 and row[2] == 1.0


def test_a_hundred_thousand_matches_in_a_text(spark):
    import time

    rows = spark.createDataFrame([("ab " * 100_000,)], "t string").withColumn("s", parties.spans(F.col("t"), "a"))
    began = time.time()
    assert rows.selectExpr("size(s)", "s[99999].start").first() == (100_000, 299_997)
    assert time.time() - began < 20


def test_chunks_are_a_plain_recursion():
    from docwright.operators.chunking import SEPARATORS, cut_points

    def plain(text, size, overlap, depth=0):
        if depth > 3:
            return [(i, text[i : i + size]) for i in range(0, len(text), size - overlap) if text[i : i + size].strip()]
        if len(text) <= size:
            return [(0, text)] if text else []
        for sep in SEPARATORS:
            at = text.rfind(sep, max(1, size - 200), size + 200)
            if at >= 0:
                cut = at + len(sep)
                back = max(0, cut - overlap)
                return [(0, text[:cut].rstrip())] + [(back + i, c) for i, c in plain(text[back:], size, overlap, depth + 1)]
        out, i = [], 0
        while i < len(text):
            stop = min(i + size, len(text))
            out += [(i, text[i:stop])] if text[i:stop].strip() else []
            if stop == len(text):
                break
            i = max(i + 1, stop - overlap)
        return out

    r = random.Random(4)
    texts = ["", "x" * 5000, " " * 3000] + ["".join(r.choice(["word ", "end. ", "\n", "\n\n", "x" * 300, " " * 250]) for _ in range(r.randint(1, 60))) for _ in range(200)]
    for t in texts:
        assert cut_points(t, 400, 150, 3) == plain(t, 400, 150)


def test_new_names_as_a_sequential_loop(spark):
    from difflib import SequenceMatcher

    r = random.Random(11)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(5, 9))) for _ in range(150)})
    rows = [(t, n) for t in ("p", "q") for n in names if r.random() < 0.8]
    known = [(1, "p", names[3]), (2, "p", names[50]), (5, "q", names[7])]
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want, made = {}, []
    left = []
    for t, n in sorted(set(rows)):
        near = [(ratio(n, k), -i) for i, u, k in known if u == t and ratio(n, k) >= 0.85]
        if near:
            want[t, n] = (-max(near)[1], False)
        else:
            left.append((t, n))
    for t, n in left:
        near = [(ratio(n, k), -i) for i, u, k in made if u == t and ratio(n, k) >= 0.85]
        if near:
            want[t, n] = (-max(near)[1], False)
        else:
            made.append((6 + len(made), t, n))
            want[t, n] = (made[-1][0], True)
    e = spark.createDataFrame([(i, t, n, []) for i, t, n in known], "entity_id long, type string, name string, aliases array<string>")
    got = {(x["type"], x["name"]): (x["entity_id"], x["created"]) for x in parties.linked_or_created(spark.createDataFrame(rows, "type string, name string"), e).collect()}
    assert got == want and 20 < len(made) < len(left)


def test_the_whole_retrieval(spark):
    rows = [(1, 10, "Delivery was late", "2024-01-05"), (2, 10, "Delivery was early", "2023-01-05"), (3, 11, "Delivery of nothing", None), (4, 11, "The weather", "2024-02-01")]
    chunks = spark.createDataFrame(rows, "id long, document_id long, text string, day string")
    asked = spark.createDataFrame([(1, "shipment")], "query_id long, text string")
    told = []

    def embed(texts):
        told.extend(texts)
        return search.HashingEmbedder()(texts)

    summaries = spark.createDataFrame([(1, 10, "overview", "document", "ten")], "summary_id long, document_id long, summary_type string, summary_level string, content string")
    expand = lambda q: q.withColumn("text", F.concat("text", F.lit(" delivery")))
    s = search.Settings(threshold=None, dates=(["day"], "2024-01-01", "2024-12-31"), query_prefix="find: ")
    got = search.retrieve(chunks, asked, ["text"], s, expand=expand, grader=lambda q, t: ["nothing" not in x for x in t], summaries=summaries).collect()
    assert {(r["id"], r["document_summary"]) for r in got if r["id"] != 4} == {(1, "ten")} and sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    plain = search.retrieve(chunks, asked, ["text"], search.Settings(threshold=None)).collect()
    assert len(got) < len(plain) or {r["id"] for r in plain} != {r["id"] for r in got}
    counts = search.stage_counts(found=spark.createDataFrame([(1, 2), (1, 3)], "query_id long, id long"), kept=spark.createDataFrame([(1, 2)], "query_id long, id long"))
    assert sorted(map(tuple, counts.collect())) == [(1, "found", 2), (1, "kept", 1)]
