"""Token counts by compiled finite-state transducers.

Two deterministic transducers read a text. The first reads classes of characters and marks where pre-tokens start; it has
twelve states, so a chunk of text is a map of twelve states to twelve. All chunks of a block are run side by side from every
state, their maps are composed by a parallel prefix scan, and with its entry state known each chunk is run once more for its marks.

The second reads the bytes of a pre-token, and its transitions are annotated with emitted tokens. Byte pair encoding is left
to right: of a string's encoding every prefix of tokens is the encoding of what it spells, and a row of tokens is an encoding if each
neighbouring pair is one. So the last token after each byte is the one vocabulary entry ending there that fits the last token where it
starts. A state holds the starts that a vocabulary entry can still reach: the trie node from there, the last
token there, and its count less the present one. A transition's annotation is the change of the count; its sum over a pre-token is the number of
tokens. States are equal if these are, and are compiled when first met, up to MOST_STATES, then thrown away but for those in use.
Pre-tokens run side by side, a byte a step.

Vocabulary and merges come from a tokenizer file of the byte-level kind, named by a parameter and read on each worker.

Defined cases: a null text is empty and has no tokens; special tokens' strings in a text are a token each, as the library's default is; a
null id stays null and ids are exact; repeated rows are rows; texts and words of any length are read whole; an empty table gives an
empty result; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.llm.bpe import byte_characters
from docwright.session import table

#: Characters of a block and of a chunk, pre-tokens side by side, compiled states (about 400 bytes each).
BLOCK, CHUNK, LANES, MOST_STATES = 1 << 20, 512, 1 << 14, 1 << 18
#: A start within a state is one number: trie node << 40 | (last token + 1) << 16 | ZERO + count less the present one.
ZERO = 1 << 15
FIRST = (ZERO,)
#: An odd factor that spreads transitions over the table.
SPREAD = 0x9E3779B1
#: So few pre-tokens are run one after the other.
FEW = 6

SPACE, WHITE, QUOTE, OTHER, DIGIT, STMD, RV, L, E, LETTER, END = range(11)
START, WORD, NUMBER, SIGNS, QUOTED, QUOTED_RV, QUOTED_L, DONE, SPACE_1, SPACES, WHITE_1, WHITES = range(12)
STATES, WIDTH = 12, 16
#: Marks of a transition: a pre-token starts at this character, or at the one before.
HERE, BEFORE = 1, 2


def pre_step(state: int, symbol: int) -> tuple[int, int]:
    """The next state and the marks: 's 't 'm 'd 're 've 'll at a start, then an optional blank with letters, digits or signs, else white space, its last character apart before other text."""
    letter = STMD <= symbol <= LETTER
    fresh = START if symbol == END else WORD if letter else {SPACE: SPACE_1, WHITE: WHITE_1, QUOTE: QUOTED, OTHER: SIGNS, DIGIT: NUMBER}[symbol]
    if state in (QUOTED_RV, QUOTED_L):
        if symbol == (E if state == QUOTED_RV else L):
            return DONE, 0
        to, marks = pre_step(WORD, symbol)
        return to, marks | BEFORE
    if symbol == END:
        return START, HERE
    if state == WORD and letter or state == NUMBER and symbol == DIGIT or state == SIGNS and symbol in (QUOTE, OTHER):
        return state, 0
    if state == QUOTED and symbol in (STMD, RV, L, QUOTE, OTHER):
        return {STMD: DONE, RV: QUOTED_RV, L: QUOTED_L}.get(symbol, SIGNS), 0
    if state >= SPACE_1:
        more = BEFORE if state in (SPACES, WHITES) else 0
        if symbol in (SPACE, WHITE):
            return SPACES if symbol == SPACE else WHITES, 0
        if state in (SPACE_1, SPACES):
            return SIGNS if symbol == QUOTE else fresh, more
        return fresh, HERE | more
    return fresh, HERE


NEXT, MARKS = np.zeros(STATES * WIDTH, np.uint8), np.zeros(STATES * WIDTH, np.uint8)
for _s in range(STATES):
    for _c in range(END + 1):
        _to, MARKS[_s * WIDTH + _c] = pre_step(_s, _c)
        NEXT[_s * WIDTH + _c] = _to * WIDTH


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\p{White_Space}", WHITE)):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
        out[[ord(c) for c in chars]] = kind
    return out


def marks(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens start: chunks' state maps from every state, their prefix scan, and a run from each entry state."""
    n = len(symbols)
    lanes = -(-n // chunk)
    rows = np.full(lanes * chunk, END, np.uint8)
    rows[:n] = symbols
    rows = np.ascontiguousarray(rows.reshape(lanes, chunk).T)
    state = np.repeat((np.arange(STATES) * WIDTH).astype(np.uint8)[:, None], lanes, 1)
    for row in rows:
        state = NEXT.take(state + row)
    maps = (state.T // WIDTH).astype(np.intp)
    step = 1
    while step < lanes:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    entry = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8) * np.uint8(WIDTH)
    found = np.empty((chunk, lanes), np.uint8)
    for k, row in enumerate(rows):
        at = entry + row
        found[k] = MARKS.take(at)
        entry = NEXT.take(at)
    found = found.T.reshape(-1)[:n]
    starts = (found & HERE) > 0
    starts[:-1] |= (found[1:] & BEFORE) > 0
    return starts


class Transducer:
    """Bytes to changes of the token count, compiled state by state."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that are not taken as they stand")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        raw = {c: b for b, c in enumerate(byte_characters())}
        self.rank, self.parts, self.born = {}, {}, {}
        for r, (a, b) in enumerate(pairs):
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            if ab in self.parts or max(self.born.get(a, -1), self.born.get(b, -1)) >= r:
                raise ValueError(f"{path} makes a token twice, or before its parts")
            self.rank[a, b], self.parts[ab], self.born[ab] = r, (a, b), r
        self.child, self.token_at, self.inner = {}, [-1], [False]
        whole: set[int] = set()
        for text, t in sorted(vocab.items(), key=lambda x: self.born.get(x[1], -1)):
            if len(text) > 1 and (t not in self.parts or not set(self.parts[t]) <= whole or self.met(*self.parts[t]) != self.parts[t]):
                continue  # no text is encoded to it
            whole.add(t)
            node = 0
            for c in text:
                self.inner[node] = True
                at = node << 8 | raw[c]
                if at not in self.child:
                    self.child[at] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = self.child[at]
            self.token_at[node] = t
        self.most = most_states
        self.forget([])

    def met(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pieces of two neighbouring tokens that merging their bytes would join across the border, if any.

        Pieces at the border grow along the right edge of a's tree and the left edge of b's, in the order of rank; of equal
        ranks the left one is merged first.
        """
        left, right = [a], [b]
        while left[-1] in self.parts:
            left.append(self.parts[left[-1]][1])
        while right[-1] in self.parts:
            right.append(self.parts[right[-1]][0])
        i, j, never = len(left) - 1, len(right) - 1, len(self.rank)
        while True:
            up_left = self.born[left[i - 1]] if i else never
            up_right = self.born[right[j - 1]] if j else never
            joins = self.rank.get((left[i], right[j]), never + 1)
            if joins < up_left and joins <= up_right:
                return left[i], right[j]
            if not i and not j:
                return None
            if up_left <= up_right and i:
                i -= 1
            else:
                j -= 1

    def forget(self, kept: list[tuple[int, ...]]) -> None:
        """Throw all states and transitions away but the first state and those given."""
        self.number: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.fit: dict[int, bool] = {}
        self.held = 0
        self.keys, self.values = np.full(1 << 12, -1, np.int64), np.zeros(1 << 12, np.int64)
        for key in [FIRST, *kept]:
            self.known(key)

    def known(self, key: tuple[int, ...]) -> int:
        """The state's number; a new one gets the next."""
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n

    def slots(self, at: np.ndarray) -> np.ndarray:
        """Where in the table each transition is, or the free slot where it would be."""
        mask = len(self.keys) - 1
        slot = (at * SPREAD >> 20) & mask
        key = self.keys.take(slot)
        off = np.flatnonzero((key != at) & (key >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            key = self.keys.take(slot[off])
            off = off[(key != at[off]) & (key >= 0)]
        return slot

    def put(self, at: int, value: int) -> None:
        mask = len(self.keys) - 1
        slot = (at * SPREAD >> 20) & mask
        while self.keys[slot] >= 0:
            slot = (slot + 1) & mask
        self.keys[slot], self.values[slot] = at, value
        self.held += 1
        if 2 * self.held > len(self.keys):
            keys, values = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            self.keys, self.values, self.held = np.full(4 * len(self.keys), -1, np.int64), np.zeros(4 * len(self.keys), np.int64), 0
            for k, v in zip(keys.tolist(), values.tolist()):
                self.put(k, v)

    def fits(self, a: int, b: int) -> bool:
        got = self.fit.get(a << 24 | b)
        if got is None:
            got = self.fit[a << 24 | b] = self.met(a, b) is None
        return got

    def compile(self, at: int) -> int:
        """The transition of state and byte `at` = state * 256 + byte: the next state * 1024 + the change + 512."""
        byte, last, change, went = at & 255, -1, 0, []
        for start in self.states[at >> 8]:
            to = self.child.get(start >> 40 << 8 | byte)
            if to is None:
                continue
            t = self.token_at[to]
            if last < 0 and t >= 0 and (not (token := start >> 16 & 0xFFFFFF) or self.fits(token - 1, t)):
                last, change = t, (start & 0xFFFF) - ZERO + 1
            if self.inner[to]:
                went.append(to << 40 | start & 0xFFFFFFFFFF)
        value = self.known((*(w - change for w in went), last + 1 << 16 | ZERO)) << 10 | change + 512
        self.put(at, value)
        return value

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The tokens of each pre-token data[start : start + length]."""
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(lengths)[::-1]
        for k in range(0, len(order), LANES):
            some = order[k : k + LANES]
            out[some] = self._side_by_side(data, starts[some], lengths[some])
        return out

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = len(starts)
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        longer = n - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1)) if n else []
        for t, m in enumerate(longer):
            if m <= FEW:
                for lane, held in enumerate([self.states[s] for s in state[:m].tolist()]):
                    total[lane] += self._alone(held, data[starts[lane] + t : starts[lane] + lengths[lane]].tolist())
                break
            at = state[:m] * 256 + data[starts[:m] + t]
            slot = self.slots(at)
            missing = self.keys.take(slot) != at
            if missing.any():
                new = np.unique(at[missing])
                if len(self.states) + len(new) > self.most:
                    live, state[:m] = np.unique(state[:m], return_inverse=True)
                    held = [self.states[s] for s in live.tolist()]
                    self.forget(held)
                    state[:m] = np.array([self.number[h] for h in held])[state[:m]]
                    at = state[:m] * 256 + data[starts[:m] + t]
                    new = np.unique(at)
                for a in new.tolist():
                    self.compile(a)
                slot = self.slots(at)
            to = self.values.take(slot)
            total[:m] += (to & 1023) - 512
            state[:m] = to >> 10
        return total

    def _alone(self, held: tuple[int, ...], rest: list[int]) -> int:
        total, state, made = 0, self.known(held), {}
        for b in rest:
            at = state * 256 + b
            to = made.get(at)
            if to is None:
                slot = self.slots(np.array([at]))[0]
                if self.keys[slot] == at:
                    to = int(self.values[slot])
                else:
                    if len(self.states) >= self.most:
                        held, made = self.states[state], {}
                        self.forget([held])
                        at = self.number[held] * 256 + b
                    to = self.compile(at)
                made[at] = to
            total += (to & 1023) - 512
            state = to >> 10
        return total

    def pieces(self, text: str, most: int = BLOCK) -> tuple[list[str], int]:
        """A text's parts between special tokens, long ones cut before white space that follows something else, and the number of special tokens."""
        parts = self.cut.split(text) if self.cut else [text]
        out = []
        for part in parts:
            start = 0
            while len(part) - start > most and (m := re.compile(r"[!-~](?=[ \n])").search(part, start + most)):
                out.append(part[start : m.end()])
                start = m.end()
            out.append(part[start:])
        return out, len(parts) - 1

    def count(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text."""
        cut = [self.pieces(t) for t in texts]
        total = np.array([n for _, n in cut], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p, _ in cut])
        parts = [p for ps, _ in cut for p in ps]
        first = 0
        while first < len(parts):
            last, size = first, 0
            while last < len(parts) and (last == first or size + len(parts[last]) <= BLOCK):
                size += len(parts[last]) + 1
                last += 1
            np.add.at(total, owner[first:last], self._count_parts(parts[first:last]))
            first = last
        return total

    def _count_parts(self, parts: list[str]) -> np.ndarray:
        joined = "\n".join(parts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        symbols = classes().take(code)
        symbols[ends] = END
        data = np.frombuffer(joined.encode(), np.uint8)
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        place = np.cumsum(width) - width
        begins = np.flatnonzero(marks(symbols))  # each end is one, so a pre-token ends where the next begins
        lengths = np.diff(place[begins], append=len(data))
        word = symbols[begins] != END
        counts = self.run(data, place[begins][word], lengths[word])
        return np.bincount(np.searchsorted(ends, begins[word]), counts, len(parts)).astype(np.int64)


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            for start, stop in text_blocks(batch.column(1)):
                texts = [x or "" for x in batch.column(1)[start:stop].to_pylist()]
                n = pa.array(t.count(texts), pa.int64())
                size = pa.array([len(x.encode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], size, n, pa.array([x > limit for x in n.to_pylist()])], ["_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("_id", id_col)


def text_blocks(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with at most `most` bytes of text, single rows excepted."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        size = len(t.as_buffer()) if t.is_valid else 0
        if total + size > most and k > start:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())
