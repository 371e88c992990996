import random
import re

import numpy as np
import pytest
from conftest_llm import SMALL, documents

from docwright.llm import ngramjoin as G


def brute(rows, n, percent):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((G.LAST_ID if i is None else i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_small_matches_brute_force(spark, n, percent):
    got = G.near_groups(spark.read.parquet(f"{SMALL}/documents.parquet"), n=n, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute(documents(SMALL), n, percent)


def test_odd_rows(spark, odd_dir):
    id_ = lambda x: None if x == G.LAST_ID else x
    want = [(id_(c), id_(i), n) for i, n, c in brute(documents(odd_dir), 3, 90)]
    got = [(r["component_id"], r["doc_id"], r["n_shingles"]) for r in G.op10_ngram_join(spark, odd_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_chains_and_edges_of_the_threshold(spark):
    r = random.Random(5)
    rows, at = [], 0
    for size in [3, 8, 11, 12, 13, 19, 20, 21, 40, 100, 300]:
        words = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            rows.append((at, " ".join(words)))
            at += 1
            for _ in range(r.choice([1, 1, 2, size // 40 + 1])):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            if r.random() < 0.3:
                words.append(f"w{r.randrange(10**6)}")
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (1, 80)):
        got = sorted(map(tuple, G.near_groups(docs, n=n, percent=percent).collect()))
        assert got == brute(rows, n, percent)


def test_short_sets_with_empty_slices(spark):
    """Sets of 7 to 13 words in 4 slices, of which many are empty, and slices that many sets share."""
    r, hashes, by_slice = random.Random(7), G.WordHashes(), [[], [], [], []]
    for i in range(4000):
        by_slice[int(G.shingle_set(f"w{i}", 1, hashes)[0]) // ((2**64 - 1) // 4)].append(f"w{i}")
    fresh = [iter(words) for words in by_slice]
    take = lambda k, m: [next(fresh[k]) for _ in range(m)]
    sets = []
    for _ in range(12):
        p, q, a, b = r.sample(range(4), 4)
        x = take(p, 4)
        y = take(q, 4)
        sets += [x + take(a, 2) + take(b, 2) + take(q, 1) for _ in range(25)]  # they make x more frequent than empty slices
        sets += [x + y + take(q, 1), x + y + take(a, 1)]  # 8 of 10 words common; slices a and b, or b, are empty
    for _ in range(6):
        base = [w for k in r.sample(range(4), 2) for w in take(k, r.randint(3, 6))]
        for _ in range(3):
            sets.append([w for w in base if r.random() > 0.08] + take(r.randrange(4), r.randint(0, 1)))
    rows = [(i, " ".join(s)) for i, s in enumerate(sets)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, G.near_groups(docs, n=1, percent=80).collect())) == brute(rows, 1, 80)


def test_sketch_bounds():
    r = np.random.default_rng(1)
    for _ in range(50):
        common = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
        a = np.unique(np.append(common, r.integers(0, 2**63, 9, dtype=np.uint64)))
        hamming = np.unpackbits((G.parity(a) ^ G.parity(common)).view(np.uint8)).sum()
        assert hamming <= len(np.setxor1d(a, common))


def test_empty_and_stage(spark, empty_dir, odd_dir):
    assert G.op10_ngram_join(spark, empty_dir).collect() == []
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = G.keep_one(docs, n=3, percent=90)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 2


def test_rows_go_and_not_ids(spark):
    """Rows without an id, and rows that repeat one, stay or go by their own texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (None, a + " more"), (None, b), (7, a + " end"), (7, c), (9, c + " end"), (9, "alone"), (11, b), (11, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, G.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(5, a), (7, c), (9, "alone"), (11, b), (11, b)], key=repr)
    got = {(r["ord_id"], r["n"], r["component"]) for r in G.near_groups(docs).collect()}
    assert got == {(5, 36, 5), (G.LAST_ID, 37, 5), (G.LAST_ID, 36, 11), (7, 37, 5), (7, 36, 7), (9, 37, 7), (9, 1, 9), (11, 36, 11)}


def test_hot_keys_are_dealt_and_blocks_meet(spark, monkeypatch):
    """Copies, hubs and slices beyond the size of a piece or block give the same groups."""
    from docwright import session

    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(1200)]
    for i in range(1200, 2600):
        some = list(words)
        for _ in range(r.choice([1, 2])):
            some[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(some)))
    monkeypatch.setattr(G, "BLOCK_ROWS", 50)
    monkeypatch.setattr(session, "HOT_SHARE", 64)
    docs = spark.createDataFrame(rows + [(9000, "something else entirely here")], "doc_id long, text string").repartition(6)
    got = {r["ord_id"]: r["component"] for r in G.near_groups(docs, n=1, percent=90).collect()}
    assert all(got[i] == 0 for i in range(2600)) and got[9000] == 9000


def test_a_bucket_is_sorted_in_parts(spark, monkeypatch):
    """Pairs of shared keys don't depend on how a bucket is parted, nor on its Arrow batches, and a task has more than one bucket."""
    r = np.random.default_rng(2)
    rows, pairs = [], []
    for _ in range(6):
        k, i = r.integers(0, 900, 500, dtype=np.uint64) << np.uint64(50), r.integers(0, 40, 500, dtype=np.uint64)
        pairs += zip(k.view(np.int64).tolist(), i.view(np.int64).tolist())
        rows.append(G.blobs(k, i, 3))
    got = {}
    for most in (10**6, 64):
        monkeypatch.setattr(G, "PART_KEYS", most)
        monkeypatch.setattr(G, "MARK_KEYS", min(8, most))
        packed = spark.createDataFrame([(int(b), bytes(k), bytes(i)) for f in rows for b, k, i in f.itertuples(index=False)], "bucket long, keys binary, ids binary")
        got[most] = sorted(map(tuple, G.shared_keys(packed).collect()))
    ids = {}
    for k, i in pairs:
        ids.setdefault(k, set()).add(i)
    assert got[64] == got[10**6] and {k for k, _ in got[64]} <= {k for k, x in ids.items() if len(x) > 1}
    monkeypatch.setattr(G, "MARK_KEYS", 8)
    parts = list(G.ranges([np.arange(1000, dtype=np.uint64)] * 2, [np.arange(1000, dtype=np.uint64)] * 2))
    assert max(len(k) for k, _ in parts) <= 64 + 2 * 8 and sum(len(k) for k, _ in parts) == 2000
    assert not {int(k[-1]) for k, _ in parts[:-1]} & {int(k[0]) for k, _ in parts[1:]}
    assert G.bucket_count(12, 0) == 48 and G.bucket_count(3000, 10**9) == 3000
