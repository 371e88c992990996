"""N-gram Jaccard join by parity sketches, and the groups of near copies it links.

A document's set is its distinct word shingles as 64-bit hashes. Two sketches are kept: parity
bits (a shingle flips one), as many as the set's size and at least 512, whose Hamming distance
never exceeds the symmetric difference, and one XOR of shingle hashes per hash slice. Sets are classed by size; in a class of sizes up to
U, linked sets differ in at most d = U * 2(1-t)/(1+t) shingles, so of n = 1.5 d slices at least n - d
agree: equal slices are the pigeonhole candidates. Sets near a class's end also enter the next
class. As n - d slices agree, every set may leave out the n - d - 1 first of its slices in one
order of all keys: those without shingles, then the most frequent keys. The agreeing slices stand
in the same order in both sets, so one of them is left. A set that shares fewer than n - d keys
with others goes without comparison, and keys from common passages make few pairs.

One pass over the texts gives sketches and keys. Keys travel once, packed by bucket of the key space: a
batch of documents gives each bucket one row, and a bucket's rows yield the keys that several sets have.
Of a key that several sets of a batch share one pair stands for the batch, so a bucket's size is
bounded by the batches. With a key goes a 48-bit hash of the set; should two sets share it, both
are candidates, and verification tells them apart. Only sets that keep a shared key are made a
second time, once, for all verification.

Candidates are not expanded into all pairs of a slice. Equal sets are one node. Each shared slice
has a leader, the member most shared overall, and a member is compared to the foremost leader of
its slices; verified links join components. While slices still hold many pairs across components, each takes a random
leader in up to two further rounds. Slices that hold several components after that are compared
pairwise in blocks, across components and under the Hamming bound, and verified exactly. No link
between components can be missed, and a group of near copies costs about its own size. Joins on
what many rows may share (a set, slice, leader, hub or label) deal the rows of a hot key to several tasks.

Defined cases: null or blank text has an empty set and no links; a text of fewer than n words is
one shingle; null ids rank last; rows that repeat an id, or have none, are documents of their own by their texts, and
rows repeated with id and text stay or go together; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docwright.session import dropped, saved, shuffle_partitions, spread_join, table

LAST_ID = 2**63 - 1
CACHE_WORDS = 200_000
LEAST_BITS = 9
CLASS_RATIO = 1.5
#: So many rows of four numbers may be broadcast.
BROADCAST_ROWS = 250_000
#: So many further rounds of leaders at most, while slices would make so many comparisons a row.
ROUNDS, CROSS_A_ROW = 2, 16
#: So many keys are packed at once, and so many shingles give a bucket of keys.
FLUSH_KEYS, BUCKET_WORDS, WORD_BYTES = 500_000, 8_000_000, 6
#: A task takes so many buckets in turn, while a row of packed keys has some ROW_KEYS.
BUCKETS_A_TASK, ROW_KEYS = 4, 1000
#: So many keys of a bucket are sorted at once; every so manieth of a row's keys tells where to part them.
PART_KEYS, MARK_KEYS = 65536, 256
#: So many texts of an Arrow batch are Python objects at a time.
PIECE_ROWS = 256
#: So many rows of a slice are compared to so many others in one group.
BLOCK_ROWS = 1000
U64 = np.uint64
#: Odd multipliers of the hash mixing.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class WordHashes(dict):
    """64-bit hashes by word, with a bound on how many are kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(MULTIPLIERS[k])
    return x ^ (x >> U64(29))


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, U64(width))
    for i in range(width):
        total = _mix(total * U64(MULTIPLIERS[1]) + h[i : len(words) - width + 1 + i], 0)
    return np.unique(total)


def class_of(size: int, limits: list[int]) -> int:
    return int(np.searchsorted(limits, size, "left"))


def limits_for(t: float, largest: int = 10**10) -> list[int]:
    """Upper sizes of the classes; the first holds the sizes where only equal sets can link."""
    least = 1
    while allowed(least + 1, t) < 1:
        least += 1
    out = [least]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
    return out


def allowed(size: int, t: float) -> int:
    """The most a set of this size may differ from a smaller or equal linked one."""
    return math.floor(size * 2 * (1 - t) / (1 + t) + 1e-9)


def slices(shingles: np.ndarray, k: int, limits: list[int], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The slices' starts, which of them have shingles, which are keys, and the first of those by frequency that is kept.

    Slices without shingles come first in the order of all keys, by number, so the n - d - 1 left out are
    always the first of them, and keys with shingles only where there are fewer.
    """
    d = allowed(limits[k], t)
    n = d + 1 + d // 2
    edges = np.arange(n, dtype=U64) * U64((2**64 - 1) // n)
    starts = np.searchsorted(shingles, edges)
    full = np.append(starts[1:], len(shingles)) > starts
    empty = np.flatnonzero(~full)
    keys = full.copy()
    keys[empty[n - d - 1 :]] = True
    return starts, full, keys, max(1, n - d - len(empty))


def slice_keys(shingles: np.ndarray, k: int, limits: list[int], t: float) -> tuple[np.ndarray, int]:
    """The keys in class k, whose lowest bit is the class's, and the first of them by frequency that is kept."""
    starts, full, kept, need = slices(shingles, k, limits, t)
    words = np.zeros(len(starts), U64)
    if full.any():
        words[full] = np.bitwise_xor.reduceat(_mix(shingles, 3), starts[full])
    at = _mix(np.arange(len(starts), dtype=U64) + U64(k << 40), 4)
    keys = _mix(words ^ at, 5) & ~U64(1) | U64(k & 1)
    return keys[kept], need


def classes_of(size: int, limits: list[int], percent: int) -> list[int]:
    """The classes a set enters: its own, unless only equal sets link there, and the next if sets there are near enough."""
    k = class_of(size, limits)
    return [k] * bool(size and k) + [k + 1] * bool(size and (limits[k] + 1) * percent <= 100 * size)


def parity(shingles: np.ndarray) -> np.ndarray:
    """One to two bits a shingle, a power of two of them: halves XORed give the sketch of half the size."""
    bits = 1 << max(LEAST_BITS, int(len(shingles) - 1).bit_length())
    odd = np.bincount((_mix(shingles, 2) >> U64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def pack(numbers: np.ndarray) -> bytes:
    """Byte planes, the highest first: of sorted or small numbers the shuffle's compression keeps only the low ones."""
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel().astype(U64)


def blobs(keys: np.ndarray, ids: np.ndarray, buckets: int) -> pd.DataFrame:
    """A row for each bucket with its pairs. A key that several sets here share has one pair there; all of its pairs go to a bucket below 0 that differs by batch."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    same = np.append(False, keys[1:] == keys[:-1])
    shared = same | np.append(same[1:], False)
    rows, salt = [], int(keys[0] ^ ids[0]) % buckets
    for known, take in ((False, ~same), (True, shared)):
        k, i = keys[take], ids[take]
        at = ((k >> U64(32)) * U64(buckets)) >> U64(32)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
        for lo, hi in zip(starts, [*starts[1:], len(at)]):
            bucket = -1 - (int(at[lo]) + salt) % buckets if known else int(at[lo])
            rows.append((bucket, pack(k[lo:hi]), pack(i[lo:hi])))
    return pd.DataFrame(rows, columns=["bucket", "keys", "ids"])


def bucket_count(partitions: int, words: int) -> int:
    """As many as there are partitions at least; few partitions get several buckets each, as a task holds one at a time."""
    return max(partitions, words // BUCKET_WORDS, min(BUCKETS_A_TASK * partitions, FLUSH_KEYS // ROW_KEYS))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that not all texts of a batch and what is made of them are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


SCAN = "ord_id long, t1 long, t2 long, n long, hi long, lo long, parity array<long>, need array<long>, bucket long, keys binary, ids binary"


def scan(rows: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """One pass over the texts of rows (ord_id, t1, t2, _text).

    It gives a row a document with its set's size, two hashes (n, hi, lo), parity sketch and the first key kept in either
    class (need), and rows of packed keys (bucket, keys, ids) where an id is the set's SHORT.
    """
    t = percent / 100
    limits = limits_for(t)
    kept = to_arrow_schema(StructType.fromDDL(SCAN))
    names = kept.names

    def wide(rows: pd.DataFrame) -> pa.RecordBatch:
        """The rows with all columns of SCAN; those that lack are null."""
        filled = [pa.array(list(rows[f.name]), f.type) if f.name in rows else pa.nulls(len(rows), f.type) for f in kept]
        return pa.RecordBatch.from_arrays(filled, schema=kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, ids, held = WordHashes(), [], [], 0
        for part in pieces(batches):
            found = []
            for id_, t1, t2, text in zip(*(c.to_pylist() for c in part.columns)):
                s = shingle_set(text, n, hashes)
                need = [0, 0]
                hi = _mix(s, 3).sum(dtype=U64)
                for k in classes_of(len(s), limits, percent):
                    own, need[k & 1] = slice_keys(s, k, limits, t)
                    keys.append(own)
                    ids.append(np.full(len(own), hi >> U64(16)))
                    held += len(own)
                lo = int(np.bitwise_xor.reduce(_mix(s, 4)).view(np.int64)) if len(s) else 0
                found.append((id_, t1, t2, len(s), int(hi.view(np.int64)), lo, parity(s), need))
                if held >= FLUSH_KEYS:
                    yield wide(blobs(np.concatenate(keys), np.concatenate(ids), buckets))
                    keys, ids, held = [], [], 0
            yield wide(pd.DataFrame(found, columns=names[:8]))
        if held:
            yield wide(blobs(np.concatenate(keys), np.concatenate(ids), buckets))

    return rows.select("ord_id", "t1", "t2", "_text").mapInArrow(run, SCAN)


def ranges(keys: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of sorted keys and their ids by ranges of keys, some PART_KEYS each, so that no copy of all of them is made."""
    marks = np.sort(np.concatenate([k[::MARK_KEYS] for k in keys]))
    edges = np.unique(marks[:: PART_KEYS // MARK_KEYS])[1:]
    cuts = [[0, *np.searchsorted(k, edges), len(k)] for k in keys]
    for i in range(len(edges) + 1):
        yield tuple(np.concatenate([x[c[i] : c[i + 1]] for x, c in zip(each, cuts)]) for each in (keys, ids))


def shared_keys(packed: DataFrame) -> DataFrame:
    """(key, short): the pairs whose key several sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_keys, packed_ids = [], []
        for batch in batches:
            packed_keys += [unpack(x) for x in batch.column("keys").to_pylist()]
            packed_ids += [unpack(x) for x in batch.column("ids").to_pylist()]
        for keys, ids in ranges(packed_keys, packed_ids):
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            first = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
            keys, ids = keys[first], ids[first]
            same = np.append(False, keys[1:] == keys[:-1])
            shared = same | np.append(same[1:], False)
            yield pa.RecordBatch.from_arrays([pa.array(x[shared].view(np.int64)) for x in (keys, ids)], names=["key", "short"])

    return packed.groupBy("bucket").applyInArrow(run, "key long, short long")


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """(nid, shingles) of rows (nid, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in pieces(batches):
            sets = [shingle_set(x, n, hashes).view(np.int64) for x in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(sets))], names=["nid", "shingles"])

    return rows.select("nid", "_text").mapInArrow(run, "nid long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of an edge table (a, b): the least node reachable, by least labels and pointer jumps.

    The rows of a hub, and of a label that many nodes share, are dealt to several tasks.
    """
    edges = edges.filter("a <> b")
    both = saved(edges.select(F.col("a").alias("from"), F.col("b").alias("node")).union(edges.select("b", "a")).distinct(), "edges")
    degrees = saved(both.groupBy("node").agg(F.count("*").alias("_many")), "degrees")
    labels = saved(both.groupBy("node").agg(F.least(F.min("from"), F.col("node")).alias("comp")), "labels")
    while True:
        near = spread_join(both, labels, "node", counts=degrees).groupBy("from").agg(F.min("comp").alias("near"))
        step = saved(labels.join(near, labels["node"] == near["from"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("up")), "labels")
        jump = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        after = saved(spread_join(step, jump, "up", "left").select("node", "was", F.coalesce(F.least("up", "top"), F.col("up")).alias("comp")), "labels")
        dropped(labels, step)
        labels = after.select("node", "comp")
        labels._saved_at = after._saved_at
        if after.filter("was <> comp").isEmpty():
            dropped(both, degrees)
            return labels


def _hamming(a: str, b: str) -> Column:
    """The differing bits; the sketches of linked sets have the same size or one has twice the other's."""
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda u, v: u.bitwiseXOR(v))
    least = lambda x, y: F.when(F.size(x) > F.size(y), folded(x)).otherwise(F.col(x))
    words = 2**LEAST_BITS // 64
    short = sum((F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(words)), F.lit(0))
    long = F.aggregate(F.zip_with(least(a, b), least(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    return F.when((F.size(a) == words) & (F.size(b) == words), short).otherwise(long)


def _sized(few: DataFrame) -> DataFrame:
    """The rows, broadcast up to a checked count; beyond it the texts are shuffled to them, once."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def _document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord_id, t1, t2, _text): two hashes of the text tell rows that repeat an id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("ord_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(29), text).alias("t2"), F.col(text_col).alias("_text"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(ord_id, t1, t2, n, component, stays), a row for each row of docs, saved.

    ord_id is the id, or LAST_ID for a null one; component the least ord_id that links reach. stays marks the rows of one
    document of each component: those of its least id, and where that has several texts in the component, of one of them.
    """
    rows = _document_rows(docs, id_col, text_col)
    spark = docs.sparkSession
    words = (rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]) // WORD_BYTES
    scanned = saved(scan(rows, n, percent, bucket_count(shuffle_partitions(spark), words)), "scanned")
    packed = scanned.filter("keys is not null").select("bucket", "keys", "ids")
    sk = scanned.filter("keys is null").select("ord_id", "t1", "t2", "n", F.struct("hi", "lo", "n").alias("set"), "parity", "need")
    row = F.min(F.struct("ord_id", "t1", "t2")).alias("row")
    sets_of = sk.filter("n > 0").groupBy("set").agg(row, F.count("*").alias("_many"), F.first("parity").alias("parity"), F.first("need").alias("need"))
    # A node is a distinct set; its number is fixed by the write.
    nodes = saved(sets_of.select(F.monotonically_increasing_id().alias("nid"), "*", F.shiftrightunsigned("set.hi", 16).alias("short")), "nodes")
    shared = saved(shared_keys(packed), "shared")
    often = saved(shared.groupBy("key").agg(F.count("*").alias("_many")), "often")
    bit = F.col("key").bitwiseAND(F.lit(1)).cast("int")
    nth = F.row_number().over(W.partitionBy("nid", "bit").orderBy(F.desc("_many"), "key"))
    ranked = spread_join(shared, often, "key", counts=often).join(nodes.select("short", "nid", "need"), "short").withColumn("bit", bit).withColumn("nth", nth)
    member = saved(ranked.filter(F.col("nth") >= F.get("need", F.col("bit"))).select("key", "nid"), "members")
    dropped(shared, often)
    light = saved(nodes.select("nid", F.col("set.n").alias("n"), "row", "parity").join(member.select("nid").distinct(), "nid", "left_semi"), "involved")
    asked = _sized(light.select("nid", F.col("row.*")))
    sets = saved(shingle_sets(rows.join(asked, ["ord_id", "t1", "t2"]), n), "sets")
    if sets.count() > light.count():  # rows repeated with id and text
        sets, once = saved(sets.dropDuplicates(["nid"]), "sets"), sets
        dropped(once)

    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    side = lambda x: light.select(F.col("nid").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    bound = F.when(fit, _hamming("pa", "pb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and parity sketches allow the similarity; many may share b."""
        pairs = saved(pairs.distinct(), "pairs")
        return spread_join(pairs, side("b"), "b").join(side("a"), "a").filter(bound).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity."""
        pairs = saved(pairs, "pairs")
        full = lambda x: sets.select(F.col("nid").alias(x), F.col("shingles").alias(f"s{x}"))
        met = spread_join(pairs, full("b"), "b").join(full("a"), "a")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        met = met.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
        return saved(met.filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b"), "links")

    many = saved(member.groupBy("key").agg(F.count("*").alias("_many")), "many")
    mass = spread_join(member, many, "key", counts=many).groupBy("nid").agg(F.sum("_many").alias("mass"))
    leaders = member.join(mass, "nid").groupBy("key").agg(F.max(F.struct("mass", (-F.col("nid")).alias("minus"))).alias("top"))
    # Its foremost leader is enough for a member: what that misses, the comparison across components finds.
    own = spread_join(member, leaders, "key", counts=many).groupBy("nid").agg((-F.max("top")["minus"]).alias("leader"))
    links = verified(near(own.filter("nid <> leader").select(F.col("nid").alias("a"), F.col("leader").alias("b"))))
    for turn in range(ROUNDS + 1):
        comp = components(links)
        placed = saved(member.join(comp, member["nid"] == comp["node"], "left").select("key", "nid", F.coalesce("comp", "nid").alias("comp")), "placed")
        parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("_many"), (F.sum("c") ** 2 - F.sum(F.col("c") ** 2)).alias("cross"))
        mixed = saved(parts.filter("cross > 0"), "mixed")
        held, work = mixed.agg(F.coalesce(F.sum("_many"), F.lit(0)), F.coalesce(F.sum("cross"), F.lit(0))).first()
        dealt = saved(spread_join(placed, mixed.select("key", F.col("_many").alias("_all")), "key", counts=many), "dealt")
        dropped(placed, comp)
        if turn == ROUNDS or work <= CROSS_A_ROW * held:
            break
        # A random leader for each slice: what is dense grows together in a few rounds at a cost of the slices' own size.
        top = dealt.groupBy("key").agg(F.min_by(F.struct("nid", "comp"), F.xxhash64("key", "nid", F.lit(turn))).alias("top"))
        met = spread_join(dealt, top, "key", counts=mixed).filter("comp <> top.comp").select(F.col("nid").alias("a"), F.col("top.nid").alias("b"))
        more = verified(near(met))
        if more.isEmpty():
            break
        links = saved(links.union(more), "links")
    # A slice of many rows is compared in blocks: each of its blocks meets each.
    blocks = F.ceil(F.col("_all") / BLOCK_ROWS).cast("int")
    left = dealt.join(light.select("nid", "n", "parity"), "nid").select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("nid"), blocks.cast("long")).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = lambda x, i, j: left.select(F.col("key").alias(f"k{x}"), F.col("nid").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"), i.alias(f"i{x}"), j.alias(f"j{x}"))
    met = (F.col("ka") == F.col("kb")) & (F.col("ia") == F.col("ib")) & (F.col("ja") == F.col("jb"))
    # The bound is part of the join: pairs beyond it are not made.
    cross = one("a", F.col("block"), every).join(one("b", every, F.col("block")), met & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & bound)
    rest = verified(cross.select("a", "b").distinct())
    final = components(links.union(rest))
    in_comp = saved(nodes.join(final, nodes["nid"] == final["node"], "left").filter("comp is not null or _many > 1").select("set", "row", F.coalesce("comp", "nid").alias("comp")), "grouped")
    first = in_comp.groupBy("comp").agg(F.min("row.ord_id").alias("component"), F.min(F.struct("row", "set")).alias("kept"))
    of_set = saved(spread_join(in_comp.select("set", "comp"), first, "comp").select("set", "component", (F.col("set") == F.col("kept.set")).alias("keeps")), "of-set")
    counts = nodes.select("set", "_many")
    found = spread_join(sk.select("ord_id", "t1", "t2", "n", "set"), of_set, "set", "left", counts=counts)
    stays = F.coalesce(F.col("keeps") & (F.col("ord_id") == F.col("component")), F.lit(True))
    out = saved(found.select("ord_id", "t1", "t2", "n", F.coalesce("component", "ord_id").alias("component"), stays.alias("stays")), "groups")
    dropped(scanned, nodes, member, light, sets, many, mixed, dealt, links, rest, final, in_comp, of_set)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(ord_id, n, component): a row for each row of docs; ord_id is the id, or LAST_ID for a null one."""
    return grouped(docs, id_col, text_col, n, percent).select("ord_id", "n", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies, that of the least id; rows go, not ids."""
    gone = grouped(docs, id_col, text_col, n, percent).filter("not stays").select("ord_id", "t1", "t2").distinct()
    text = F.coalesce(docs[text_col], F.lit(""))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)) == gone["ord_id"]) & (F.xxhash64(text) == gone["t1"]) & (F.xxhash64(F.lit(29), text) == gone["t2"])
    return docs.join(gone, same, "left_anti")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), n=3, percent=90)
    id_ = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(id_("ord_id").alias("doc_id"), F.col("n").alias("n_shingles"), id_("component").alias("component_id"))
