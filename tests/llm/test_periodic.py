import hashlib
import random
import zlib

import pytest
from conftest_llm import SMALL, documents

from docwright.llm import periodic as P


def brute(s, exponent=2, length=2):
    """All runs by comparing every period at every place."""
    out, n = {}, len(s)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i + q >= 2 * q and not any((i, j + q - i, p) in out for p in range(1, q)):
                smaller = any(all(s[k] == s[k + p] for k in range(i, j + q - p)) for p in range(1, q))
                if not smaller:
                    out[i, j + q - i, q] = 1
            i = j
    return sorted((r for r in out if r[1] >= max(length, exponent * r[2])), key=lambda r: (r[0], r[2]))


def words_of(text):
    out = [""]
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def want(id_, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(("" if id_ is None else str(id_)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, 4, 6)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[0][0], best[0][1], best[0][2], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return id_, len(runs), *first, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def strings():
    r = random.Random(1)
    for letters in (1, 2, 3, 4):
        for _ in range(400):
            yield [r.randrange(letters) for _ in range(r.randint(0, 40))]
    for _ in range(200):
        s = []
        while len(s) < 40:
            s += [r.randrange(4) for _ in range(r.randint(1, 6))] * r.randint(1, 5)
        yield s
    a, b = [0], [0, 1]
    for _ in range(8):
        a, b = b, b + a
    yield b


def test_all_runs():
    for s in strings():
        assert sorted(P.all_runs(s), key=lambda r: (r[0], r[2])) == brute(s), s


def test_vocabulary_is_whole():
    """Marks after the walk are all the kinds of square with a plain half."""
    for k, s in enumerate(strings()):
        if k % 7 or len(s) < 2:
            continue
        tree = P.SuffixTree(s)
        marks = P.squares_marked(tree, P.covering_squares(s, tree.blocks()))
        got = {(h, tuple(s[tree.least[v] : tree.least[v] + 2 * h])) for h, first in marks.items() for v in P.walked(tree, h, first)}
        assert got == {(h, tuple(s[i : i + 2 * h])) for h in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * h + 1) if s[i : i + h] == s[i + h : i + 2 * h]}, s


@pytest.mark.parametrize("exponent, length", [(4, 6), (2, 2), (3, 4), (4, 2), (6, 12)])
def test_texts_cut_into_stretches(exponent, length):
    texts = [[b"%d" % x for x in s] for s in strings()]
    assert P.found_runs(texts, exponent, length) == [brute(s, exponent, length) for s in texts]


@pytest.mark.parametrize("where", ["small", "odd"])
def test_query(spark, odd_dir, where):
    d = SMALL if where == "small" else odd_dir
    docs = [x for x in documents(d) if len(words_of(x[1])) < 1500]
    got = {repr(tuple(r)) for r in P.op12_periodic_runs(spark, d).collect()}
    assert {repr(want(i, t)) for i, t, *_ in docs} <= got and len(docs) > 40


def test_long_text():
    r = random.Random(3)
    base = [b"%d" % r.randrange(10**6) for _ in range(3000)]
    (runs,) = P.found_runs([[b"x"] * 5000 + base * 5 + base[:7] + [b"y", b"z"] * 4000])
    assert runs == [(0, 5000, 1), (5000, 15007, 3000), (20007, 8000, 2)]


def test_collapsed(spark):
    rows = [(None, "a b " * 6 + "c", 1), (2**53 + 1, "a  b\nc", 1), (3, None, 1), (3, "", 1), (4, "x " * 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").coalesce(1)
    assert [tuple(r) for r in P.collapse_runs(docs).collect()] == [(None, "a b c", 1), (2**53 + 1, "a  b\nc", 1), (3, None, 1), (3, "", 1), (4, "x", 1)]
    assert [r["doc_id"] for r in P.run_digests(docs).collect()] == [i for i, *_ in rows]


def test_empty(spark, empty_dir):
    assert P.op12_periodic_runs(spark, empty_dir).collect() == []
