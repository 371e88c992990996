"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a maximal stretch of words with a smallest period q. A text is first cut, exactly, into stretches that can hold
one: of each window of words inside a run of the asked exponent there are several in the text. Each stretch gets a suffix tree. A Lempel-Ziv
factorisation is read off the tree; around each block, common extensions from its two borders give squares that cover the
leftmost occurrence of every kind of square. Their ends are marked in the tree, bottom-up, and from a mark a suffix-link walk goes
on from rotation to rotation while the tree holds it: then the vocabulary of squares is complete. The leaves below a
mark are the square's occurrences; occurrences of one period that follow each other merge into a run. Squares whose half is
itself a power lie in a run of a smaller period, which is found first, and are not located.

The work is linear in a stretch, and n log n in the occurrences. Texts are independent, so a task reads rows as they come.

Defined cases: a null text has no words and the hash of no runs and of an empty text; words of any number and length are taken
whole; a null id counts as the empty string where its checksum is taken; repeated rows are rows; an empty table gives an empty
result; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.llm.tokencount import text_blocks
from docwright.session import table

EXPONENT, LENGTH = 4, 6
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

Run = tuple[int, int, int]


class SuffixTree:
    """The suffix tree of a sequence of numbers, built from left to right; each node has its depth, parent, suffix link and smallest leaf."""

    def __init__(self, s: list[int]):
        s = [*s, -1]
        n = self.n = len(s)
        self.s = s
        begin, end, link, child = [0], [0], [0], {}
        edges: list[list[int]] = [[]]
        node, edge, length = 0, 0, 0
        leaf_of: dict[int, int] = {}
        rest = 0
        for i, c in enumerate(s):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = i
                first = s[edge]
                to = child.get((node, first))
                if to is None:
                    child[node, first] = len(begin)
                    edges[node].append(first)
                    leaf_of[len(begin)] = i - rest + 1
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    edges.append([])
                    if last:
                        link[last] = node
                    last = 0
                else:
                    size = min(end[to], i + 1) - begin[to]
                    if length >= size:
                        edge += size
                        length -= size
                        node = to
                        continue
                    if s[begin[to] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(begin)
                    begin.append(begin[to])
                    end.append(begin[to] + length)
                    link.append(0)
                    edges.append([s[begin[to] + length], c])
                    child[node, first] = split
                    begin[to] += length
                    child[split, s[begin[to]]] = to
                    child[split, c] = len(begin)
                    leaf_of[len(begin)] = i - rest + 1
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    edges.append([])
                    if last:
                        link[last] = split
                    last = split
                rest -= 1
                if not node and length:
                    length -= 1
                    edge = i - rest + 1
                elif node:
                    node = link[node]
        self.child, self.link, self.edges = child, link, edges
        self._finish(begin, end, leaf_of)

    def _finish(self, begin: list[int], end: list[int], leaf_of: dict[int, int]) -> None:
        """Depths and parents from above, smallest leaves and the leaves' order from below."""
        m = len(begin)
        depth, parent, order, todo = [0] * m, [0] * m, [], [0]
        leaves, low = [], [0] * m
        while todo:
            v = todo.pop()
            order.append(v)
            low[v] = len(leaves)
            if v in leaf_of:
                leaves.append(leaf_of[v])
                continue
            for c in self.edges[v]:
                to = self.child[v, c]
                parent[to] = v
                depth[to] = depth[v] + end[to] - begin[to]
                todo.append(to)
        least, count = [self.n] * m, [0] * m
        for v in reversed(order):
            if v in leaf_of:
                least[v], count[v] = leaf_of[v], 1
            if v:
                up = parent[v]
                count[up] += count[v]
                if least[v] < least[up]:
                    least[up] = least[v]
        self.depth, self.parent, self.order, self.least, self.low, self.count = depth, parent, order, least, low, count
        self.leaves = np.array(leaves)

    def blocks(self) -> list[int]:
        """Where the Lempel-Ziv blocks start: each is the longest prefix of the rest that starts earlier too, or a new symbol."""
        s, starts, at = self.s, [], 0
        while at < self.n - 1:
            starts.append(at)
            node, size = 0, 0
            while True:
                to = self.child[node, s[at + size]]
                if self.least[to] >= at:
                    break
                node, size = to, self.depth[to]
            at += max(size, 1)
        return starts


def extensions(pattern: list[int], text: list[int]) -> list[int]:
    """For each place of text the length of the longest common prefix with pattern, by one pass over each."""
    both = [*pattern, -2, *text]
    n, z = len(both), [0] * len(both)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and both[k] == both[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z[len(pattern) + 1 :]


def covering_squares(s: list[int], starts: list[int]) -> list[tuple[int, int]]:
    """(start, half) of squares such that the leftmost occurrence of each kind is one of them or follows one through rotations."""
    n, out = len(s), []
    borders = [*starts, n, n]
    for b, h in enumerate(starts):
        h1 = borders[b + 1]
        size = h1 - h
        # The centre is in the block and the square goes on beyond it.
        if h1 < n:
            ahead = extensions(s[h1 : h1 + size], s[h : h1 + size])
            behind = extensions(s[max(0, h - size) : h1][::-1], s[max(0, h - size) : h1][::-1])
            for k in range(1, size + 1):
                q = h1 - k
                k1 = min(ahead[q - h], k)
                if k1 <= 0:
                    continue
                k2 = min(behind[k], k - 1) if k < len(behind) else 0
                if k1 + k2 >= k:
                    out.append((max(q - k2, q - k + 1), k))
        # The square starts before the block and its centre is in it, or it starts with it.
        reach = borders[min(b + 2, len(borders) - 1)] - h
        ahead = extensions(s[h : h + 2 * reach], s[h : h + 2 * reach])
        from_ = max(0, h - reach)
        behind = extensions(s[from_:h][::-1], s[from_ : h + reach][::-1])
        for k in range(1, reach + 1):
            q = h + k
            k1 = min(ahead[k], k) if k < len(ahead) else 0
            if k1 <= 0:
                continue
            # The last word before q stands at place h + reach - q of the reversed text.
            k2 = min(behind[min(n, h + reach) - q], k - 1) if h and q <= min(n, h + reach) and h > from_ else 0
            start = max(h - k2, h - k + 1)
            if k1 + k2 >= k and start + k <= h1:
                out.append((start, k))
    return out


def squares_marked(tree: SuffixTree, squares: list[tuple[int, int]]) -> dict[int, set[int]]:
    """The nodes below which each half's squares end, first marks only: lists of squares rise with the smallest leaf."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for start, half in squares:
        waiting[start].append(2 * half)
    for sizes in waiting.values():
        sizes.sort()
    marks: dict[int, set[int]] = defaultdict(set)
    for v in reversed(tree.order):
        sizes = waiting.get(tree.least[v])
        above = tree.depth[tree.parent[v]]
        while sizes and sizes[-1] > above and v:
            size = sizes.pop()
            if size <= tree.depth[v]:
                marks[size // 2].add(v)
    return marks


def walked(tree: SuffixTree, half: int, first: set[int]) -> set[int]:
    """All nodes below which squares of this half end: from each mark on to the next rotation, by suffix link and down again."""
    s, child, depth, least, link, parent = tree.s, tree.child, tree.depth, tree.least, tree.link, tree.parent
    found = set(first)
    for v in first:
        while True:
            i, up = least[v], parent[v]
            at = link[up] if up else 0
            goal = 2 * half - 1
            while depth[at] < goal:
                to = child[at, s[i + 1 + depth[at]]]
                if depth[to] > goal:
                    break
                at = to
            if depth[at] == goal:
                to = child.get((at, s[i]))
                if to is None:
                    break
            elif s[least[to] + goal] != s[i]:
                break
            if to in found:
                break
            found.add(to)
            v = to
    return found


def divisors(k: int) -> list[int]:
    """Those below k."""
    small = [d for d in range(1, int(k**0.5) + 1) if k % d == 0]
    return [d for d in sorted({*small, *(k // d for d in small)}) if d < k]


def all_runs(s: list[int]) -> list[Run]:
    """(start, length, period) of every run of at least two periods."""
    if len(s) < 2:
        return []
    tree = SuffixTree(s)
    marks = squares_marked(tree, covering_squares(s, tree.blocks()))
    runs: dict[int, tuple[list[int], list[int]]] = {}
    for half in sorted(marks):
        smaller = [runs[d] for d in divisors(half) if d in runs]

        def plain(v: int) -> bool:
            """Whether no run of a smaller period holds the square."""
            i = tree.least[v]
            for begins, ends in smaller:
                k = int(np.searchsorted(begins, i, "right")) - 1
                if k >= 0 and ends[k] >= i + 2 * half:  # noqa: B023
                    return False
            return True

        nodes = {v for v in marks[half] if plain(v)}
        if not nodes:
            continue
        at = np.sort(np.concatenate([tree.leaves[tree.low[v] : tree.low[v] + tree.count[v]] for v in walked(tree, half, nodes)]))
        cut = np.flatnonzero(np.diff(at) > 1)
        begins, ends = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 2 * half
        runs[half] = begins.tolist(), ends.tolist()
    return sorted((b, e - b, q) for q, (begins, ends) in runs.items() for b, e in zip(begins, ends))


def stretches(words: np.ndarray, text: np.ndarray, exponent: int, length: int) -> list[tuple[int, int]]:
    """[start, stop) of all stretches of words (numbers; text: each word's text) that can hold a run, in order.

    Inside a run of four periods and six words each window of three words is one of three equal ones at least; inside one of two
    periods each word is one of two.
    """
    width, least = (3, 3) if exponent >= 4 and length >= 6 else (1, 2)
    n = len(words) - width + 1
    if n < 1:
        return []
    with np.errstate(over="ignore"):
        code = text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(width):
            code = (code ^ words[k : n + k].astype(np.uint64)) * np.uint64(MIX[k])
            code ^= code >> np.uint64(29)
    order = np.argsort(code)
    ranked = code[order]
    edge = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, [n]])
    good = np.empty(n, bool)
    good[order] = np.repeat(np.diff(edge) >= least, np.diff(edge))
    good &= text[:n] == text[width - 1 :]
    ends = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    out = []
    for a, b in zip(ends[::2].tolist(), ends[1::2].tolist()):
        b += width - 1
        # Neighbouring texts' stretches touch where windows are single words.
        for p in [a, *(np.flatnonzero(np.diff(text[a:b])) + a + 1).tolist()]:
            stop = int(np.searchsorted(text[a:b], text[p], "right")) + a
            if stop - p >= length:
                out.append((p, stop))
    return out


def found_runs(texts: list[list[bytes]], exponent: int = EXPONENT, length: int = LENGTH) -> list[list[Run]]:
    """Each text's runs (start, length, period) of at least `exponent` periods and `length` words, by start, then period."""
    number: dict[bytes, int] = {}
    get = number.setdefault
    words = np.fromiter((get(w, len(number)) for ws in texts for w in ws), np.int64)
    sizes = np.array([len(ws) for ws in texts], np.int64)
    text, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    out: list[list[Run]] = [[] for _ in texts]
    known: dict[bytes, list[Run]] = {}
    for a, b in stretches(words, text, exponent, length):
        key = words[a:b].tobytes()
        if key not in known:
            known[key] = [r for r in all_runs(words[a:b].tolist()) if r[1] >= max(length, exponent * r[2])]
        t = int(text[a])
        out[t] += [(a - int(first[t]) + s, n, q) for s, n, q in known[key]]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def planted(words: list[bytes], id_: int | None) -> list[bytes]:
    """The query's input: every tenth checksum's text is made periodic from some word on."""
    n, h = len(words), zlib.crc32(b"" if id_ is None else str(id_).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * (-(-(n - a) // p)))[: n - a]]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


RUNS = "_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, length: int = LENGTH, prepare=None) -> DataFrame:
    """(id, n_runs, the longest run, hashes of all runs and of the collapsed text); `prepare` changes a text's words (words, id) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            for a, b in text_blocks(raw, 1 << 21):
                ids = batch.column(0)[a:b].to_pylist()
                texts = [(t or b"").split() for t in raw[a:b].to_pylist()]
                if prepare:
                    texts = [prepare(ws, i) for ws, i in zip(texts, ids)]
                rows = []
                for words, runs in zip(texts, found_runs(texts, exponent, length)):
                    start, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    rows.append((len(runs), start, size, q, 1000 * size // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
                    ["_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, RUNS).withColumnRenamed("_id", id_col)


def collapse_runs(docs: DataFrame, text_col: str = "text", exponent: int = EXPONENT, length: int = LENGTH) -> DataFrame:
    """docs whose texts with runs keep each run's first period only, words joined by one blank; other texts stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).cast(pa.binary())
            for a, b in text_blocks(raw, 1 << 21):
                before = raw[a:b].to_pylist()
                texts = [(t or b"").split() for t in before]
                after = [b" ".join(collapsed(ws, r)) if r else t for t, ws, r in zip(before, texts, found_runs(texts, exponent, length))]
                columns = [c[a:b] for c in batch.columns]
                columns[at] = pa.array(after, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_type(pa.string()) if k == at else f for k, f in enumerate(batch.schema)]))

    return docs.mapInArrow(run, docs.schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), prepare=planted)
