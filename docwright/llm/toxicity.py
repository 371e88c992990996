"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the mean of hashed rows for the word and its four- and five-letter starts
(inflected forms share them). Filters of widths one to three slide over the words, ReLU and a max
over the whole text give one feature a filter, and a logistic layer scores them. Training is Adam
on the bounded labelled sample; one embedding axis starts from each row's smoothed log-odds. The
language is guessed from a text's letters; for each language the logit threshold with the best F1
on rows kept apart is moved to `SHOWN`, so one cut-off serves all languages.

Bound (a parameter): LABELLED rows to learn from. Scoring reads whole texts, in blocks of words.

Defined cases: null and blank texts get the score of a text without words; without labels, or
with labels of one class, the score is constant; an empty table gives an empty result; labels,
lang, source and doc_id are no inputs of a score; null ids stay null and long ids exact; repeated rows are rows, scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.llm.labelled import Adam, held_out, labelled_sample, sigmoid
from docwright.session import own_name, table

LABELLED = 8000
ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 32, 0.01
SHOWN = 0.3
PRIOR = 4
CACHE_WORDS = 150_000
BLOCK_WORDS = 100_000
PAD = 2
STRIP = ".,;:!?*#$%&|\"'()[]«»-"
#: Letters that mark a language; a text without enough of them counts as "en".
LETTERS = {"de": "äöüß", "es": "ñíóáú¿", "fr": "èêçàùâîôé"}


def language(text: str) -> str:
    hits = {k: sum(map(text.count, v)) for k, v in LETTERS.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] * 200 >= max(1, len(text)) else "en"


def word_rows(word: str) -> tuple[int, int, int]:
    w = word.strip(STRIP).encode("utf-8", "surrogatepass")
    start = w.decode("utf-8", "ignore")
    code = lambda mark, s: zlib.crc32(mark + s) % (ROWS - 1) + 1  # noqa: E731  row 0 is the pad
    if not w:
        return 0, 0, 0
    return code(b"w", w), code(b"4", start[:4].encode()), code(b"5", start[:5].encode())


def tokens(text: str) -> list[str]:
    return text.lower().split()


def conv(parts: list[np.ndarray], bias: np.ndarray, pads: np.ndarray) -> np.ndarray:
    """ReLU outputs (positions, filters) of each width from per-offset contributions; rows at pads are 0."""
    out = []
    for w, width in enumerate(WIDTHS):
        total = np.tile(bias[w], (len(pads), 1)).astype(np.float32)
        for o in range(width):
            part = parts[w * (w + 1) // 2 + o]
            total[: len(pads) - o] += part[o:]
        out.append(total)
    out = np.maximum(np.concatenate(out, 1), 0)
    out[pads] = 0
    return out


def packed(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of several texts with PAD pad rows after each: rows, starts, whether a pad."""
    pad = np.zeros((PAD, 3), np.int32)
    rows = np.concatenate([x for words in lists for x in (words, pad)]) if lists else pad[:0]
    sizes = np.array([len(x) + PAD for x in lists])
    starts = np.cumsum(sizes) - sizes
    pads = np.zeros(len(rows), bool)
    for k in range(PAD):
        pads[starts + sizes - 1 - k] = True
    return rows, starts, pads


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = (0.05 * r.standard_normal((ROWS, DIM))).astype(np.float32)
        self.table[0] = 0
        self.filters = [(0.3 * r.standard_normal((DIM, FILTERS))).astype(np.float32) for w in WIDTHS for _ in range(w)]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.base = np.zeros(1, np.float32)
        self.shift: dict[str, float] = {}
        self.constant: float | None = None

    def start_from(self, lists: list[np.ndarray], y: np.ndarray) -> None:
        """Axis 0: smoothed log-odds of each row in texts of either label; the first filter reads it."""
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        seen = np.repeat(PRIOR * n[:, None] / n.sum(), ROWS, 1)  # prior texts, divided as the labels are
        for words, label in zip(lists, y):
            seen[int(label), np.unique(words)] += 1
        odds = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
        rare = seen.sum(0) < PRIOR + 2
        odds[rare] = 0
        odds[0] = 0
        self.table[:, 0] = np.clip(odds, -4, 4) * 0.5
        for f in self.filters:
            f[0, : FILTERS // 2] = np.abs(f[0, : FILTERS // 2]) + 0.3
        self.bias[:, : FILTERS // 2] = -0.3
        self.out[: FILTERS // 2] = 1.0
        self.base[:] = -1.5

    def features(self, rows: np.ndarray, starts: np.ndarray, pads: np.ndarray):
        x = self.table[rows].mean(1)
        act = conv([x @ f for f in self.filters], self.bias, pads)
        return x, act, np.maximum.reduceat(act, starts, 0)

    def train(self, lists: list[np.ndarray], y: np.ndarray) -> None:
        r = np.random.default_rng(11)
        weight = np.where(y == 1, np.clip(0.3 * len(y) / max(1, (y == 1).sum()), 1, 5), 1.0)
        adam = Adam([self.table, *self.filters, self.bias, self.out, self.base], RATE)
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                rows, starts, pads = packed([lists[i] for i in some])
                x, act, top = self.features(rows, starts, pads)
                g = ((sigmoid(top @ self.out + self.base) - y[some]) * weight[some] / len(some)).astype(np.float32)
                g_out, g_base = top.T @ g, np.array([g.sum()], np.float32)
                g_top = np.outer(g, self.out) * (top > 0)
                ends = np.append(starts[1:], len(rows))
                at = np.array([act[a:b].argmax(0) + a for a, b in zip(starts, ends)])
                g_x, g_bias, g_filters = np.zeros_like(x), np.zeros_like(self.bias), [np.zeros_like(f) for f in self.filters]
                for w, width in enumerate(WIDTHS):
                    for f in range(FILTERS):
                        c = w * FILTERS + f
                        place, grad = at[:, c], g_top[:, c]
                        g_bias[w, f] = grad.sum()
                        for o in range(width):
                            j = w * (w + 1) // 2 + o
                            here = np.minimum(place + o, len(rows) - 1)
                            np.add.at(g_x, here, np.outer(grad, self.filters[j][:, f]))
                            g_filters[j][:, f] += grad @ x[here]
                g_table = np.zeros_like(self.table)
                hot = np.flatnonzero(g_x.any(1))
                for c in range(3):
                    np.add.at(g_table, rows[hot, c], g_x[hot] / 3)
                g_table[0] = 0
                adam.step([g_table, *[a + 1e-4 * f for a, f in zip(g_filters, self.filters)], g_bias, g_out + 1e-4 * self.out, g_base])

    def logits(self, lists: list[np.ndarray]) -> np.ndarray:
        out = [np.zeros(0)]
        for k in range(0, len(lists), BATCH):
            out.append(self.features(*packed(lists[k : k + BATCH]))[2] @ self.out + self.base)
        return np.concatenate(out)

    def calibrate(self, logits: np.ndarray, y: np.ndarray, langs: list[str]) -> None:
        """The logit threshold of best F1 for each language with enough positives, else for all."""

        def best(z: np.ndarray, t: np.ndarray) -> float:
            order = np.argsort(-z, kind="stable")
            hits = np.cumsum(t[order])
            f1 = 2 * hits / (np.arange(1, len(z) + 1) + t.sum())
            top = np.flatnonzero(f1 >= f1.max() - 1e-12)
            k = top[len(top) // 2]
            return float((z[order][k] + (z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1)) / 2)

        langs_ = np.array(langs)
        self.shift[""] = best(logits, y)
        for lang in sorted(set(langs)):
            mine = langs_ == lang
            if y[mine].sum() >= 15 and (1 - y[mine]).sum() >= 15:
                self.shift[lang] = best(logits[mine], y[mine])


def fit(labelled: pd.DataFrame) -> Net:
    net = Net()
    lists = [np.array([word_rows(w) for w in tokens(t)], np.int32).reshape(-1, 3) for t in labelled["text"]]
    y = labelled["_y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        net.constant = 0.0 if not len(y) else float(y[0])
        return net
    learn = np.flatnonzero(labelled["_part"] > 0)
    apart = np.flatnonzero(labelled["_part"] == 0)
    if not y[learn].any() or y[learn].all():
        learn = np.arange(len(y))
    net.start_from([lists[i] for i in learn], y[learn])
    net.train([lists[i] for i in learn], y[learn])
    apart = apart if y[apart].sum() >= 5 else np.arange(len(y))
    net.calibrate(net.logits([lists[i] for i in apart]), y[apart], [language(labelled["text"][i]) for i in apart])
    return net


class Scorer:
    """Whole texts to scores; per-offset contributions of each word are kept in a bounded table."""

    def __init__(self, net: Net):
        self.net, self.known = net, {}
        self.parts = np.zeros((CACHE_WORDS + 1, len(net.filters) * FILTERS), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        new = set(words) - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, set(words)
        if new:
            first = len(self.known) + 1
            if first + len(new) > len(self.parts):
                self.parts = np.resize(self.parts, (first + len(new), self.parts.shape[1]))
            x = self.net.table[np.array([word_rows(w) for w in new])].mean(1)
            self.parts[first : first + len(new)] = np.concatenate([x @ f for f in self.net.filters], 1)
            self.known.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def pooled(self, texts: list[list[str]]) -> np.ndarray:
        sizes = np.array([len(t) + PAD for t in texts])
        starts = np.cumsum(sizes) - sizes
        at = np.zeros(int(sizes.sum()), np.int64)
        pads = np.ones(len(at), bool)
        words = [w for t in texts for w in t]
        place = np.arange(len(words)) + np.repeat(np.arange(len(texts)) * PAD, sizes - PAD)
        at[place], pads[place] = self.rows(words), False
        got = self.parts[at]
        got[pads] = 0
        return np.maximum.reduceat(conv([got[:, k * FILTERS : (k + 1) * FILTERS] for k in range(len(self.net.filters))], self.net.bias, pads), starts, 0)

    def score(self, texts: list[str]) -> np.ndarray:
        net = self.net
        if net.constant is not None:
            return np.full(len(texts), net.constant)
        top = np.zeros((len(texts), len(net.out)), np.float32)
        group, owners, many = [], [], 0

        def flush():
            nonlocal group, owners, many
            if group:
                np.maximum.at(top, owners, self.pooled(group))
            group, owners, many = [], [], 0

        for i, text in enumerate(texts):
            words = tokens(text)
            step = BLOCK_WORDS - max(WIDTHS) + 1  # pieces of a long text overlap by a filter
            for k in range(0, max(1, len(words)), step):
                piece = words[k : k + BLOCK_WORDS]
                group.append(piece)
                owners.append(i)
                many += len(piece)
                if many >= BLOCK_WORDS:
                    flush()
        flush()
        shift = np.array([net.shift.get(language(t), net.shift.get("", 0.0)) for t in texts])
        return sigmoid((top @ net.out + net.base - shift) + np.log(SHOWN / (1 - SHOWN)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: list[str], labelled: int = LABELLED, score: str = "_score") -> DataFrame:
    """The columns `keep` of docs, untouched, with a score in the column of that name."""
    learn = labelled_sample(docs, labels, "toxic", labelled, ["text"])
    net = docs.sparkSession.sparkContext.broadcast(fit(learn))  # ROWS x DIM weights
    rows, n = docs.select(*keep), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net.value)
        for batch in batches:
            made = pa.array(scorer.score(batch.column(n).to_pylist()).astype(float), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made], names=[*keep, score])

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias(own_name(rows, "_text"))).mapInArrow(run, rows.schema.add(score, "double"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity_scores(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= SHOWN).cast("int").alias("predicted"))
