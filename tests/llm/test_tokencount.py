import random

import numpy as np
import pytest
from conftest_llm import SMALL, documents
from tokenizers import Tokenizer as Library

from docwright.llm import tokencount as T

LETTERS = "abcdefgh 'stremdllve0123456789éÉßΣσςİıñ中文字😀̀́\t\n\u0085 　  \x1c\x1f_-—…%$<|>endoftext" + "क्षिẞﬁＡ²Ⅷ" + "   ''''"


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(T.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("where", ["small", "odd"])
def test_matches_library(spark, odd_dir, library, where):
    d = SMALL if where == "small" else odd_dir
    docs = documents(d)
    n = want(library, [t or "" for _, t, *_ in docs])
    got = sorted((tuple(r) for r in T.op13_token_counts(spark, d).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), k, k > 512) for (i, t, *_), k in zip(docs, n)), key=repr)


def test_random_unicode(library):
    r = random.Random(2)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 80))) for _ in range(4000)]
    texts += ["".join(map(chr, r.choices([*range(0xD800), *range(0xE000, 0x110000)], k=40))) for _ in range(500)]
    texts += ["<|endoftext|>", "a<|endoftext|>B <|endoftext|>", "x" * 3000, "ab" * 5000, "inging" * 300, "!" * 700, "'", "'r", "'re", "'l", "''ll", "it's'", " 're", "\n\n\n", "a \n \n b"]
    t = T.Transducer(T.vocabulary())
    assert t.count(texts).tolist() == want(library, texts)


def test_one_pre_token_of_bytes(library):
    """Long rows of letters from few, so that merges meet across every border."""
    r = random.Random(9)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "ing", "tion", "etaoinshrdlu", "=-", "éßñ", "中文字日本語") for n in [*range(1, 40), 500]]
    assert T.Transducer(T.vocabulary()).count(texts).tolist() == want(library, texts)


def test_states_thrown_away(library, monkeypatch):
    monkeypatch.setattr(T, "LANES", 16)
    r = random.Random(4)
    t = T.Transducer(T.vocabulary(), most_states=40)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(200)] + ["".join(r.choice("etaoinshrdlu") for _ in range(3000))]
    assert t.count(texts).tolist() == want(library, texts)
    assert len(t.states) < 100


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 512])
def test_scan_is_a_plain_run(chunk):
    r = np.random.default_rng(3)
    symbols = r.integers(0, T.END + 1, 1500).astype(np.uint8)
    state, starts = T.START, np.zeros(1500, bool)
    for k, s in enumerate(symbols.tolist()):
        state, m = T.pre_step(state, s)
        starts[k] |= bool(m & T.HERE)
        if k and m & T.BEFORE:
            starts[k - 1] = True
    assert (T.marks(symbols, chunk) == starts).all()


def test_long_texts(library, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    r = random.Random(6)
    t = T.Transducer(T.vocabulary())
    texts = ["".join(r.choice(LETTERS) for _ in range(5000)) for _ in range(5)] + ["z" * 4000]
    cut = [t.pieces(x, 50)[0] for x in texts]
    assert ["".join(c) for c in cut[:1]] == ["".join(T.Transducer(T.vocabulary()).cut.split(texts[0]))] and len(cut[0]) > 20
    whole = want(library, texts)
    monkeypatch.setattr(t, "pieces", lambda x: T.Transducer.pieces(t, x, 50))
    assert t.count(texts).tolist() == whole


def test_ids(spark, library):
    rows = [(None, "a b", 1), (2**53 + 1, "it's", 1), (-(2**63), None, 1), (7, "x", 1), (7, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").coalesce(1)
    got = T.token_counts(docs, T.vocabulary()).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, n) for (i, *_), n in zip(rows, want(library, [t or "" for _, t, _ in rows]))]


def test_empty(spark, empty_dir):
    assert T.op13_token_counts(spark, empty_dir).collect() == []
