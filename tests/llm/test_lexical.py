import math
import random
import re
from collections import Counter

import pytest
from conftest_llm import SMALL, rows_of, rows_of_sql, view

from docwright.llm import lexical as L

TERM = re.compile(L.TERM)
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, top=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in {(i, t): 0 for i, t in items if t is not None}:
        asked = Counter(TERM.findall(text.translate(LOWER)))
        rows = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, times in asked.items() if w in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(None if none else i, item, k + 1, -s) for k, (s, none, i) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


def test_matches_sql(spark):
    con = view(SMALL)
    con.execute(f"create view benchmark as select * from '{SMALL}/benchmark.parquet'")
    got = rows_of(L.op11_ranked_search(spark, SMALL))
    assert len(got) > 20 and got == rows_of_sql(con, L.OP11_SQL)


@pytest.mark.parametrize("shard_bytes, block_items", [(1, 1), (200, 3), (1 << 20, 512)])
def test_matches_brute_force(spark, shard_bytes, block_items):
    r = random.Random(5)
    words = ["a", "B", "cé", "É", "x1", "ünï", "'", "-", "the", "The", "of", "😀z", "\x7f", "q"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)]
    docs += [(3, docs[3][1]), docs[5], docs[5], (None, "the q the"), (None, "the q the"), (2**53 + 1, "the q the"), (-(2**63), "the q the"), (9, None), (10, ""), (11, "-- ''")]
    docs += [(1000 + i, "tied words") for i in range(40)]
    items = [(k, " ".join(r.choice(words) for _ in range(8))) for k in range(9)] + [(0, "tied"), (0, "tied"), (0, "words of"), (None, "q q q the"), (50, None), (51, ""), (52, "zzz"), (2**53 + 1, "tied q")]
    rows = spark.createDataFrame([(i, t, "x", None) for i, t in docs], "doc_id long, text string, score string, _query long").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = L.ranked_search(rows, asked, shard_bytes=shard_bytes, block_items=block_items)
    assert rows_of(got) == brute(docs, items)


def test_empty_and_odd(spark, empty_dir, odd_dir):
    asked = spark.createDataFrame([(1, "one two words")], "item_id long, text string")
    assert L.ranked_search(spark.read.parquet(f"{empty_dir}/documents.parquet"), asked).collect() == []
    odd = spark.read.parquet(f"{odd_dir}/documents.parquet")
    assert L.ranked_search(odd, asked.limit(0)).collect() == []
    docs = [(x["doc_id"], x["text"]) for x in odd.collect()]
    items = [(1, "one two words"), (2, "the long line repeats shared LINE")]
    assert rows_of(L.ranked_search(odd, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_ties_in_selection():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(0, 30))
        scores, ids, known = r.integers(0, 4, n), r.integers(-3, 3, n), r.random(n) < 0.7
        want = sorted((-s, not k, i) for s, i, k in zip(scores, ids, known) if s > 0)[:5]
        assert [(-scores[p], not known[p], ids[p]) for p in L.best(scores, ids, known, 5)] == want
