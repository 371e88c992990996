import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docwright.operators import answers, graph


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_resolution_matches_brute_force(spark):
    known = [("org", 1, "Acme Trading", ["ACME"]), ("org", 2, "Acme Tradings", []), ("person", 3, "Acme Trading", []), ("org", 4, "Beta", None)]
    asked = [("org", "acme trading"), ("org", "Acme Tradin"), ("person", "Acme Trad1ng"), ("org", "beta co"), ("org", " "), ("org", None)]
    got = graph.resolved(spark.createDataFrame(asked, "type string, name string"), spark.createDataFrame(known, "type string, entity_id long, name string, aliases array<string>"))
    want = set()
    for kind, name in asked:
        low = (name or "").strip().lower()
        scored = [(SequenceMatcher(None, low, n.lower()).ratio(), -i) for k, i, c, al in known if k == kind for n in [c, *(al or [])]] if low else []
        if scored and max(scored)[0] >= 0.85:
            want.add((kind, low, -max(scored)[1], round(max(scored)[0], 9)))
    assert {(r["type"], r["name"], r["entity_id"], round(r["similarity"], 9)) for r in got.collect()} == want


def test_resolution_of_names_with_another_first_letter(spark):
    r = random.Random(2)
    known = [("org", 1, "Johnson Trading"), ("org", 2, "The Acme Holdings"), ("org", 3, "Aohnson Tradeng"), ("org", 4, "Xohnson Trading"), ("org", 5, "")]
    known += [("org", i, "".join(r.choice("abcé ") for _ in range(r.randint(1, 14)))) for i in range(6, 90)]
    asked = ["ohnson Trading", "Acme Holdings", "Aohnson Trading", "a"]
    for _, _, name in known[5:]:
        at = r.randrange(len(name))
        asked += [name[1:], r.choice("abcé") + name, name[:at] + r.choice("abcé") + name[at + 1 :]]
    got = graph.resolved(spark.createDataFrame([("org", a) for a in asked], "type string, name string"), spark.createDataFrame([(*k, None) for k in known], "type string, entity_id long, name string, aliases array<string>"))
    want = set()
    for low in {a.strip(" ").lower() for a in asked} - {""}:
        ratio, minus = max((SequenceMatcher(None, low, n.lower()).ratio(), -i) for _, i, n in known)
        if ratio >= 0.85:
            want.add((low, -minus, round(ratio, 9)))
    assert ("ohnson trading", 1) in {w[:2] for w in want}
    assert {(x["name"], x["entity_id"], round(x["similarity"], 9)) for x in got.collect()} == want


def test_days_are_read_in_three_spellings(spark):
    text = "On 1st march 2020, 31/02/2021 and 2022-13-40; not 01/13/2020."
    assert one(spark, text, graph.dated_days) == ["2020-03-01", "2021-02-31", "2022-13-40"]


def test_answers(spark):
    assert one(spark, None, answers.input_guard) == "block"
    assert one(spark, "Please ACT AS A judge", answers.input_guard) == "warning"
    assert one(spark, "<|channel|>final<|message|>a<|end|><|channel|>final<|message|> b ", answers.final_channel) == "b"
    assert one(spark, "plain ", answers.final_channel) == "plain"
    assert one(spark, "lead-in rate?", answers.search_words) == "lead-in OR rate"
    assert one(spark, "??", answers.search_words) == '""'
    assert one(spark, "```json\n{broken\n```", lambda c: answers.fenced_json(c, "a int"))["a"] is None


def test_uncited_sentences_leave_refusals_out(spark):
    text = "He came home. [Source: a.pdf | Page 2] The court cannot answer this. It was late at night and raining. No."
    rows = answers.uncited_sentences(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string"), "id", "t").collect()
    assert [(r["id"], r["sentence"]) for r in rows if "late" in r["sentence"]] == [(1, "It was late at night and raining.")]
    assert not [r for r in rows if "cannot" in r["sentence"]]


def test_context_and_cascade(spark):
    m = spark.createDataFrame([(1, 10, "B"), (1, 11, "A"), (1, 10, "B"), (2, 12, "C")], "text_id long, entity_id long, name string")
    v = spark.createDataFrame([(5, 10, "2020", "x"), (5, 11, "2020", "x"), (6, 11, "2019", "y")], "event_id long, entity_id long, day string, label string")
    got = {r["text_id"]: (r["entities"], r["events"]) for r in graph.context(m, v).collect()}
    assert got == {1: (["A", "B"], ["y", "x"]), 2: (["C"], None)}
    left = graph.cascade(m.filter("entity_id = 10"), "entity_id", {"m": (m, ("entity_id",))})["m"]
    assert left.count() == 2
    assert {(r["kind"], r["n"]) for r in graph.kind_counts(m, "name", ["A", "Z"]).collect()} == {("A", 1), ("Z", 0)}
