"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's tree holds, at each leaf, the merge rank of the pair that starts there. The root names
the leftmost lowest-ranked pair; a merge changes three leaves, each updated along its path, until
the root has no mergeable pair. New words of a batch are encoded together: words of one tree size
form a forest of trees in one matrix, merged in lockstep by numpy; a long word with few of its size gets a tree of
plain numbers. Words' ids are kept in a bounded cache, so a text costs a lookup a word. Decoding starts from the ids. Vocabulary, merges, normalizer and word pattern
come from a tokenizer file of the BPE kind with word ends, named by a parameter and read on each
worker.

Defined cases: null text is empty and gives no tokens (hashes of the empty string); words of any
length are encoded whole; special tokens in a text are their ids; other columns pass through `encode` untouched, whatever their
names; null ids stay null and long ids exact; repeated rows are rows; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docwright.session import own_name, table

#: A generation of the cache holds so many words, and so many characters of them, besides one block's. A word and its ids take some 240 bytes.
CACHE_WORDS, CACHE_CHARS = 100_000, 8 << 20
FOREST = 1 << 16
#: Words whose tree has more leaves than this for each word of that size are merged one by one.
LONG_LEAVES = 64
NONE = np.int32(2**31 - 1)
SUFFIX = "</w>"
#: Words of the file's split pattern; white space between them is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: The same for texts of ASCII and the Latin letters from U+00C0 to U+024F, once they are lower case.
LATIN = r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*"
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]|[^ \t-\ra-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Tokenizer:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.span = max(self.names) + 1
        codes = left * self.span + right
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        chars = byte_characters()
        self.plain = np.array([vocab[c] for c in chars], np.int64)
        self.ends = np.array([vocab[c + SUFFIX] for c in chars], np.int64)
        self.words = regex.compile(PATTERN)
        self.latin_words = re.compile(LATIN_PATTERN)
        self.latin = re.compile(LATIN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.numbers = [str(i) for i in range(self.span)]
        self.texts = {str(i): t for i, t in self.names.items()}
        self.rank_of = dict(zip(codes.tolist(), range(len(codes))))
        # Two generations of each word's ids.
        self.ids: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.chars = 0

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.span + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_forest(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        """Merge each row in place. symbols: (words, leaves) ids, -1 beyond a word's length; leaves a power of two."""
        n, leaves = symbols.shape
        rows = np.arange(n)
        # The key orders by rank, then place; a tree is stored level by level from index 1 (the root).
        key = lambda rank, place: rank.astype(np.int64) * leaves + place
        tree = np.empty((n, 2 * leaves), np.int64)
        ranks = np.full((n, leaves), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(symbols[:, :-1], symbols[:, 1:])
        tree[:, leaves:] = key(ranks, np.arange(leaves))
        width = leaves
        while width > 1:
            width //= 2
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        after = np.broadcast_to(np.arange(1, leaves + 1), (n, leaves)).copy()
        before = np.broadcast_to(np.arange(-1, leaves - 1), (n, leaves)).copy()
        after[after >= lengths[:, None]] = -1
        live = rows
        while len(live):
            root = tree[live, 1]
            live = live[root // leaves != NONE]
            if not len(live):
                break
            root = tree[live, 1]
            rank, at = root // leaves, root % leaves
            gone = after[live, at]
            symbols[live, at] = self.merged[rank]
            symbols[live, gone] = -1
            follow = after[live, gone]
            after[live, at] = follow
            some = follow >= 0
            before[live[some], follow[some]] = at[some]
            prior = before[live, at]
            next_id = np.where(some, symbols[live, follow], -1)
            prior_id = np.where(prior >= 0, symbols[live, prior], -1)
            here = symbols[live, at]
            for place, value in ((at, self.pair_ranks(here, next_id)), (gone, None), (prior, self.pair_ranks(prior_id, here))):
                value = np.full(len(live), NONE) if value is None else value
                rows_, at_, value = (live, place, value) if place is not prior else (live[prior >= 0], place[prior >= 0], value[prior >= 0])
                node = at_ + leaves
                tree[rows_, node] = key(value, at_)
                node = node >> 1
                while len(node) and node[0]:
                    tree[rows_, node] = np.minimum(tree[rows_, 2 * node], tree[rows_, 2 * node + 1])
                    node = node >> 1

    def merge_word(self, symbols: list[int]) -> list[int]:
        """As merge_forest for one word, on a tree of plain numbers: for long words that few others share a tree size with."""
        n = len(symbols)
        leaves, span, rank_of, merged = 1 << max(1, (n - 1).bit_length()), self.span, self.rank_of, self.merged
        none = int(NONE) * leaves
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = rank_of.get(symbols[i] * span + symbols[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, b: int) -> None:
            rank = rank_of.get(symbols[at] * span + symbols[b]) if b < n else None
            node = at + leaves
            value = none if rank is None else rank * leaves + at
            while node and tree[node] != value:
                tree[node] = value
                value = min(value, tree[node ^ 1])
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = after[at]
            symbols[at], after[at] = int(merged[rank]), after[gone]
            symbols[gone] = -1
            if after[gone] < n:
                before[after[gone]] = at
            put(gone, n)
            put(at, after[at])
            if before[at] >= 0:
                put(before[at], at)
        return [x for x in symbols if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Put the words' decimal ids, joined by spaces, in the cache."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        data = np.frombuffer(b"".join(raws), np.uint8)
        starts = np.cumsum(lengths) - lengths
        size = np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for power in np.unique(size):
            leaves, group = 1 << int(power), np.flatnonzero(size == power)
            step = max(1, FOREST // leaves)
            for k in range(0, len(group), step):
                some = group[k : k + step]
                n = lengths[some]
                if leaves > LONG_LEAVES * len(some):
                    for i in some.tolist():
                        raw = data[starts[i] : starts[i] + lengths[i]]
                        merged = self.merge_word([*self.plain[raw[:-1]].tolist(), int(self.ends[raw[-1]])])
                        self.ids[words[i]] = " ".join(map(self.numbers.__getitem__, merged))
                    continue
                row = np.repeat(np.arange(len(some)), n)
                col = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                symbols = np.full((len(some), leaves), -1, np.int64)
                symbols[row, col] = self.plain[data[np.repeat(starts[some], n) + col]]
                symbols[np.arange(len(some)), n - 1] = self.ends[data[starts[some] + n - 1]]
                self.merge_forest(symbols, n)
                numbers = list(map(self.numbers.__getitem__, symbols[symbols >= 0].tolist()))
                at = 0
                for i, more in zip(some.tolist(), (symbols >= 0).sum(1).tolist()):
                    self.ids[words[i]] = " ".join(numbers[at : at + more])
                    at += more

    def normalized(self, part: str) -> str:
        if not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        # Lower case works a character at a time: no final sigma.
        return "".join(c.lower() for c in part) if "Σ" in part else part.lower()

    def find_words(self, part: str) -> list[str]:
        """Runs of white space become one space in the normalizer, and the pattern drops them: they are left as they are."""
        part = self.normalized(part)
        return (self.latin_words if self.latin.fullmatch(part) else self.words).findall(part)

    def split(self, text: str) -> list[str]:
        """Words of a text, special tokens whole."""
        if self.parts is None or not self.parts.search(text):
            return self.find_words(text)
        out = []
        for part in self.parts.split(text):
            out += [part] if part in self.special else self.find_words(part)
        return out

    def know(self, words: set[str]) -> None:
        """Have the words in the young generation; it turns old when it is full."""
        if len(self.ids) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.old, self.ids, self.chars = self.ids, {}, 0
        for word, i in self.special.items():
            self.ids[word] = str(i)
        fresh = []
        for w in words - self.ids.keys():
            self.chars += len(w)
            if w in self.old:
                self.ids[w] = self.old[w]
            else:
                fresh.append(w)
        if fresh:
            self.learn(fresh)

    def forget(self) -> None:
        """Let the words of both generations go."""
        self.old, self.ids, self.chars = {}, {}, 0

    def encode_batch(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by single spaces."""
        split = [self.split(t) for t in texts]
        self.know(set().union(*split))
        ids = self.ids.__getitem__
        return [" ".join(map(ids, ws)) for ws in split]

    def decode(self, ids: str) -> str:
        """Token texts of decimal ids, as a decoder-less tokenizer joins them."""
        return " ".join(map(self.texts.__getitem__, ids.split(" "))) if ids else ""


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def blocks(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` characters, single ones excepted."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total > most and k > start:
            yield start, k
            start, total = k, len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, text_col: str = "text", names: tuple[str, str, str] = ("_ids", "_tokens", "_decoded")) -> DataFrame:
    """docs, without their text, with the columns `names`: decimal ids joined by spaces, their number, the decoded text; names that docs has get an underscore more."""
    rest = docs.drop(text_col)
    names = tuple(own_name(rest, n) for n in names)
    kept = rest.columns
    n = len(kept)
    schema = StructType([*rest.schema.fields, *(StructField(c, t) for c, t in zip(names, (StringType(), LongType(), StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(n).to_pylist()]
            for a, b in blocks(texts):
                ids = t.encode_batch(texts[a:b])
                made = [pa.array(ids, pa.string()), pa.array([x.count(" ") + (x != "") for x in ids], pa.int64()), pa.array([t.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:n]), *made], names=[*kept, *names])

    return docs.select(*kept, F.col(text_col).alias(own_name(rest, "_text"))).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256); the decoded text is decode() of the ids. keep_words: a worker's later tasks find the words of the earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids = t.encode_batch(texts[a:b])
                made = [pa.array([x.count(" ") + (x != "") for x in ids], pa.int64()), pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(t.decode(x)) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *made], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep_words:
            t.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary())
