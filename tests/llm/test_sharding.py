import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import SMALL, documents

from docwright.llm import sharding as S


@pytest.mark.parametrize("where", ["small", "odd"])
def test_law(spark, odd_dir, where):
    d = SMALL if where == "small" else odd_dir
    got = S.op8_sharding(spark, d).collect()
    raw = lambda t: (t or "").encode()
    want = Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t, *_ in documents(d))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, loads = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    mean, largest = sum(loads.values()) / 16, max(r["size"] for r in got)
    assert all(abs(loads[s] - mean) <= largest for s in range(16))


def test_hot_text_splits_by_id(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(2000)], "doc_id long, text string")
    loads = Counter(r["shard"] for r in S.shard_by_bytes(docs, 8).collect())
    assert max(loads.values()) < 1.1 * min(loads.values())


def test_empty(spark, empty_dir):
    assert S.op8_sharding(spark, empty_dir).collect() == []
