import random

import duckdb
import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()),
                     T.StructField("size", T.IntegerType()), T.StructField("rest", T.StringType())])


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing extra columns."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(40) for _ in range(5)]
    texts = [None, "", " ", "\n\n", "A", "one two", "\t\x0b\x0c\r shared line here \n x", "Shared Line HERE\ny", "shared line here\nshared line here"]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join(w[:20] + ["zzz"] + w[21:]), b + " tail", " ".join(w[:39])]
    texts += ["the long line repeats\n" * 300 + prose(3000), "x" * 5000, "😀 ünï — ｆｕｌｌ width \u0085   Σ ς İ I'm they'll <|endoftext|> 123"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "é", None, "big", "big", "big"]), None if t is None else len(t), "k", 1, None))
    rows += [rows[12], rows[12], (None, "null id here, with words", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i * 3, i % 2, (i // 2) % 2) for i in range(0, 40, 2)] + [(None, None, None), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def view(d, name="documents"):
    import os

    p = f"{d}/{name}.parquet"
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


def documents(d):
    return view(d).execute("select doc_id, text, lang, source from documents").fetchall()
