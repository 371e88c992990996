import hashlib
import itertools
import random

import pytest
from conftest_llm import SMALL, documents
from tokenizers import Tokenizer as Library

from docwright.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(B.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))


@pytest.mark.parametrize("where", ["small", "odd"])
def test_matches_library(spark, odd_dir, library, where):
    d = SMALL if where == "small" else odd_dir
    got = sorted((tuple(r) for r in B.op2_bpe(spark, d).collect()), key=repr)
    assert got == sorted(((i, *want(library, t)) for i, t, *_ in documents(d)), key=repr)


def test_random_unicode(library):
    r = random.Random(2)
    t = B.Tokenizer(B.vocabulary())
    letters = "abcXYZ 'stremdll0123456789éÉßΣσςİIıñ中文字😀̀́\t\n\u0085  \x1c\x1f_-—…%$<|>endoftext" + "क्षिẞﬁＡ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>B <|endoftext|>", "x" * 3000, "ab" * 5000, "inging" * 300, "!" * 700]
    for text, got in zip(texts, t.encode_batch(texts)):
        e = library.encode(text, add_special_tokens=False)
        assert got == " ".join(map(str, e.ids)), text
        assert t.decode(got) == library.decode(e.ids, skip_special_tokens=False), text


def test_cache_bound(monkeypatch):
    monkeypatch.setattr(B, "CACHE_WORDS", 3)
    t = B.Tokenizer(B.vocabulary())
    first = t.encode_batch(["some words go in and out"] * 2)
    assert t.encode_batch(["some words go in and out"])[0] == first[0]


def test_cache_counts_the_words_it_takes_over(monkeypatch):
    monkeypatch.setattr(B, "CACHE_CHARS", 100)
    t = B.Tokenizer(B.vocabulary())
    words = ["".join(w) for w in itertools.product("abcdef", repeat=4)]
    for n in range(10, 200, 10):  # words come again from the old generation, and a few new ones with them
        for k in range(0, n, 10):
            t.encode_batch([" ".join(words[k : k + 10])])
            assert len(t.ids) - len(t.special) <= 40


@pytest.mark.parametrize("long_leaves", [0, 10**9])
def test_either_tree(library, monkeypatch, long_leaves):
    monkeypatch.setattr(B, "LONG_LEAVES", long_leaves)
    r = random.Random(8)
    t = B.Tokenizer(B.vocabulary())
    texts = ["".join(r.choice("abcdefghijéß") for _ in range(n)) for n in [1, 2, 3, 4, 5, 8, 9, 31, 32, 33, 200] * 8] + ["e" * 40, "in" * 50]
    assert t.encode_batch(texts) == [" ".join(map(str, library.encode(x, add_special_tokens=False).ids)) for x in texts]


def test_word_of_a_million_letters(library):
    r = random.Random(4)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(10**6))
    (got,) = B.Tokenizer(B.vocabulary()).encode_batch([word])
    assert hashlib.sha256(got.encode()).hexdigest() == want(library, word)[1]


def test_empty(spark, empty_dir):
    assert B.op2_bpe(spark, empty_dir).collect() == []


def test_words_go_when_told():
    t = B.Tokenizer(B.vocabulary())
    first = t.encode_batch(["some words go, and come again"])
    t.forget()
    assert not t.ids and not t.old and t.chars == 0
    assert t.encode_batch(["some words go, and come again"]) == first
