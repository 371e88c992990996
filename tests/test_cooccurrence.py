import math
import random
from itertools import combinations

import pytest

from docwright.operators.cooccurrence import cooccurring


def plain(mentions, least, share):
    held = {}
    for c, e in mentions:
        if c is not None and e is not None:
            held.setdefault(e, set()).add(c)
    n = len(set().union(*held.values())) if held else 0
    out = {}
    for a, b in combinations(sorted(held), 2):
        k, union = len(held[a] & held[b]), len(held[a] | held[b])
        if k >= least and k / union >= share:
            pmi = 1.0 if k == n else math.log(k * n / (len(held[a]) * len(held[b]))) / math.log(n / k)
            out[a, b] = (k, len(held[a]), len(held[b]), round(k / union, 9), round(pmi, 9))
    return out


def rows(df):
    return {(r["a"], r["b"]): (r["together"], r["a_chunks"], r["b_chunks"], round(r["jaccard"], 9), round(r["npmi"], 9)) for r in df.collect()}


@pytest.mark.parametrize("least,share", [(1, 0.0), (3, 0.0), (2, 0.3), (1, 0.5), (5, 0.05), (1, 1.0)])
def test_same_pairs_as_counting_all(spark, least, share):
    draw = random.Random(least * 10 + share)
    made = [(draw.randrange(40), f"e{int(draw.paretovariate(0.7)) % 25}") for _ in range(700)]
    made += [(c, "hub") for c in range(40)] + [(7, f"e{k}") for k in range(60)] + [(7, "e1"), (None, "e1"), (3, None)]  # a hub, a heavy chunk
    made += [(50 + k // 2, f"twin{k % 2}") for k in range(6)]
    df = spark.createDataFrame(made, "chunk long, entity string")
    want = plain(made, least, share)
    assert want and rows(cooccurring(df, "chunk", "entity", least, share)) == want


def test_everywhere_together_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "c long, e long")
    assert rows(cooccurring(df, "c", "e", 2)) == {(5, 6): (2, 2, 2, 1.0, 1.0)}
    assert rows(cooccurring(df.limit(0), "c", "e", 1)) == {}
    with pytest.raises(ValueError):
        cooccurring(df, "c", "e", 0)
