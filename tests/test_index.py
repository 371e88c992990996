"""The match grammar and the positional index beside an embedded full-text engine; stored segments beside a plain dict."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from docwright.functions.text import terms
from docwright.operators import match, positions, search, segments

TEXTS = ["one three", "one two three", "one two", "two three one", "john smith", "john-smith", "Smith, John", "café ÉCOLE", "foo_bar foo", "a b a b c", "", None, "threefold two one one", "the b a c"]
EXPRESSIONS = ["one NOT two three", "one two three", "one NOT two OR smith", "one AND two NOT three", "one OR two AND three NOT smith", "john-smith", "john:smith", "(one)two", "one (two)", "(one OR two) AND three",
               '"john smith"', '"one two" + three', "one + two", "thr*", "one + tw *", '"one tw"*', '"', '"a ""b"""', "foo_bar", "AND", "one AND", "one NOT", "(one", "one)", '""', 'one "" two', 'one AND ""', 'one OR ""',
               'one NOT ""', "NOT one", "café", "ÉCOLE", "a + b + a", "one one", "*", "one * two", "one** ", "one OR OR two", "(one NOT two) OR (three NOT one)", "and OR not", "two* one + thr*"]


@pytest.fixture(scope="module")
def engine():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 0')")
    c.executemany("insert into t(rowid, x) values (?, ?)", [(k, x) for k, x in enumerate(TEXTS)])
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("index"))
    positions.write(spark, where, docs, "id", ["t"])
    return where


def asked(engine, expression):
    try:
        return dict(engine.execute("select rowid, -bm25(t) from t where t match ?", (expression,)).fetchall())
    except sqlite3.OperationalError:
        return None


def test_grammar(spark, engine, docs):
    good = []
    for e in EXPRESSIONS:
        try:
            match.parse(e)
            good.append(e)
        except ValueError:
            assert asked(engine, e) is None, e
    rows = docs.select("id", *[match.matches(terms(F.col("t")), e).alias(f"e{k}") for k, e in enumerate(good)]).collect()
    for k, e in enumerate(good):
        assert {r["id"] for r in rows if r[f"e{k}"]} == set(asked(engine, e)), e
    assert len(good) > 20


@pytest.mark.parametrize("expression", ["one NOT two three", "(one OR two) AND three", "one + tw *", "a + b + a", '(one NOT two) OR (three NOT one)', "two* one + thr*", "foo_bar"])
def test_index(spark, engine, folder, expression):
    assert {r["id"] for r in positions.match(spark, folder, expression).collect()} == set(asked(engine, expression))


@pytest.mark.parametrize("expression", ["two", "one OR smith", '"one two" OR three', "thr* AND one", "one NOT smith"])
def test_ranks_are_the_engines(spark, engine, folder, expression):
    got = {r["id"]: r["score"] for r in positions.ranked_match(spark, folder, expression).collect()}
    assert got == pytest.approx(asked(engine, expression), abs=2e-6)


def test_hyphen_falls_back_to_substrings(spark, docs):
    assert {r["id"] for r in search.match_search(docs, F.col("t"), "john-smith").collect()} == {5}


def test_index_takes_updates(spark, tmp_path):
    r, where, held = random.Random(3), str(tmp_path / "i"), {}
    words = ["ab", "abc", "b", "c", "d"]
    for turn in range(4):
        new = {r.randrange(12): " ".join(r.choices(words, k=r.randint(0, 6))) for _ in range(6)}
        positions.write(spark, where, spark.createDataFrame(list(new.items()), "id long, t string"), "id", ["t"])
        held |= new
        if turn % 2:
            gone = r.sample(sorted(held), 2)
            positions.erase(spark, where, spark.createDataFrame([(g,) for g in gone], "id long"), "id")
            held = {k: v for k, v in held.items() if k not in gone}
        if turn == 2:
            positions.compact(spark, where)
        c = sqlite3.connect(":memory:")
        c.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 0')")
        c.executemany("insert into t(rowid, x) values (?, ?)", held.items())
        for e in ('"b c" OR ab*', "ab NOT d"):
            assert {x["id"]: x["score"] for x in positions.ranked_match(spark, where, e).collect()} == pytest.approx(asked(c, e), abs=2e-6)


def test_common_terms_are_left_out_by_statistics(spark, folder):
    plan = positions.postings(spark, folder, F.col("term").isin("one"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [one])]" in plan or "EqualTo(term,one)" in plan


@pytest.mark.parametrize("order", [None, "at"])
def test_segments_beside_a_dict(spark, tmp_path, order):
    r, where, held = random.Random(8), str(tmp_path / "s"), {}
    for turn in range(9):
        if turn % 4 == 3:
            gone = r.choices([None, *range(6)], k=2)
            segments.erase(spark, where, spark.createDataFrame([(g,) for g in gone], "k long"))
            held = {k: v for k, v in held.items() if k not in gone}
        else:
            rows = [(r.choice([None, *range(6)]), r.randrange(20), f"v{turn}-{i}") for i in range(4)]
            if order is None:
                rows = list({k: (k, a, v) for k, a, v in rows}.values())
            else:
                rows = list({(k, a): (k, a, v) for k, a, v in rows}.values())
            segments.write(spark, where, spark.createDataFrame(rows, "k long, at int, v string"), "k", order, most_deltas=3)
            for k, a, v in rows:
                if k not in held or order is None or a >= held[k][0]:
                    held[k] = (a, v)
        if turn == 7:
            segments.compact(spark, where, 1)
        assert {x["k"]: (x["at"], x["v"]) for x in segments.read(spark, where).collect()} == held


def test_an_update_writes_its_own_size(spark, tmp_path):
    where = str(tmp_path / "s")
    segments.write(spark, where, spark.range(10_000).withColumn("v", F.lit("a")), "id")
    segments.write(spark, where, spark.range(100).withColumn("v", F.lit("b")), "id")
    assert segments.manifest(spark, where)["written"] == 10_100
    assert segments.read(spark, where).filter("v = 'b'").count() == 100 and segments.read(spark, where).count() == 10_000


def test_two_writers_do_not_lose_a_write(spark, tmp_path):
    where = str(tmp_path / "s")
    segments.write(spark, where, spark.range(3), "id")
    m = segments.manifest(spark, where)
    segments.write(spark, where, spark.range(4), "id")
    with pytest.raises(Exception, match="exist"):
        segments._commit(spark, where, m, m)
