from docwright.operators import made_graph, store


def test_answers_give_what_they_can(spark):
    summaries = spark.createDataFrame([("a.pdf", "good"), ("b.pdf", "broken"), ("c.pdf", None), (None, "half")], "name string, content string")

    def model(asked):
        said = {"good": '```json\n[{"type": "person", "name": "Ann", "aliases": ["A"], "confidence": 0.5}, {"type": "person", "name": "Bo"}]\n```',
                "half": '[{"type": "person", "name": "Ann", "aliases": ["Annie"]}, {"type": "place", "name": "X"}, {"type": "phone"}]'}
        return [next((v for k, v in said.items() if p.endswith(k)), "no") for p in asked]

    found = made_graph.entities_of(summaries, model)
    assert sorted((r["document"] or "", r["name"], r["confidence"]) for r in found.collect()) == [("", "Ann", 0.8), ("a.pdf", "Ann", 0.5), ("a.pdf", "Bo", 0.8)]
    known = {r["name"]: r for r in made_graph.numbered(found).collect()}
    assert known["Ann"]["aliases"] == ["A", "Annie"] and known["Ann"]["documents"] == 1 and known["Ann"]["confidence"] == 0.8
    assert made_graph.entities_of(summaries.limit(0), model).count() == 0


def test_relations_know_their_ends(spark):
    entities = spark.createDataFrame([(1, "Ann", ["A"]), (2, "Bo Ltd", None)], "entity_id long, name string, aliases array<string>")

    def model(prompts):
        return ['[{"source": "a", "target": "BO LTD", "type": "employed_by"}, {"source": "Ann", "target": "Cy", "type": "signed"}]' if "Known entities: Ann, Bo Ltd\n" in p else "[]" for p in prompts]

    rows = made_graph.relations_of(spark.createDataFrame([("d", "x")], "name string, content string"), entities, model).collect()
    assert [(r["source_id"], r["target_id"], r["confidence"]) for r in rows] == [(1, 2, 0.8)]


def test_days_of_events(spark):
    model = lambda prompts: ['[{"date": "2024-02-30"}, {"date": "2024-02-29", "event_type": "hearing", "entities": ["A"]}, {"event_type": "feast"}, {"date": null, "date_text": "in May"}, null]'] * len(prompts)
    rows = made_graph.events_of(spark.createDataFrame([("d", "x")], "name string, content string"), model).collect()
    assert sorted((str(r["day"]), r["date_text"], r["kind"]) for r in rows) == [("2024-02-29", "", "hearing"), ("None", "", "other"), ("None", "in May", "other")]


def test_reextraction_replaces_the_graph(spark, tmp_path):
    folder = str(tmp_path)
    store.publish(spark.createDataFrame([("old",)], "x string"), f"{folder}/accepted")
    store.publish(spark.createDataFrame([("9", "old", "accepted")], "document_id string, document_name string, status string"), f"{folder}/queue")
    records = spark.createDataFrame([(1, "a", "email", "hello", True), (2, "b", "email", None, True), (3, "c", "email", "x", False), (4, "d", None, "y", None)],
                                    "document_id long, name string, kind string, text string, include_in_graph boolean")
    report = {r["what"]: r["n"] for r in made_graph.reextract(spark, folder, records).collect()}
    assert report == {"extracted": 1, "failed": 1, "document": 1}
    assert [tuple(r) for r in store.current(spark, f"{folder}/queue").collect()] == [("1", "a", "pending")]
    assert not store.exists(spark, f"{folder}/accepted")
