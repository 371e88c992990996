"""Ranked lexical search over document-sharded postings with integer impacts.

Each task turns its documents into shards of about SHARD_BYTES of text: a shard holds its documents' ids, its sorted
terms, and their postings as compressed sparse rows (offsets by term, document numbers, impacts). An impact is
the integer (1000000000*tf) div (1000*tf+8*m) of a posting, made once when the shard is written; a query multiplies it by
the term's weight. Queries go in blocks that the driver streams; for a block one pass sums document frequencies, a second scores: term at
a time, a query adds weight times impact to a dense accumulator over the shard's documents, a partition finds the
value of the last row that can be kept, and of the rows tied with it the smallest ids are taken. A task keeps the best
rows of all its shards, and windows merge the tasks' rows, first by a hash of the id, then by query.

Terms are runs of ASCII letters and digits and of all characters above ASCII; only A-Z are lower-cased.

Defined cases: a null text has no terms; documents without terms are in no shard and not counted; a null id sorts after all others;
documents that repeat an id, or a whole row, are documents of their own; queries that repeat id and text count once, equal ids with
different texts are ranked separately under their id; a null query id is an id; words asked for twice count twice; empty tables give an
empty result; texts of any length are indexed whole; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from docwright.session import dropped, saved, shuffle_partitions, table

SHARD_BYTES = 6 << 20
#: Items and characters of a block of queries.
BLOCK_ITEMS, BLOCK_CHARS = 512, 1 << 22
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 to themselves, A-Z to a-z, bytes outside terms to a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SHARDS = "ids binary, known binary, terms array<binary>, offsets binary, docs binary, impacts binary"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLDED).split()


def collection(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Documents with a term, and the terms of all."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(TERM)), F.lit(0)).cast("long")
    got = docs.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return got[0], got[1]


class _Shard:
    """Documents gathered until a shard is full."""

    def __init__(self):
        self.ids, self.known, self.numbers, self.lengths, self.vocabulary, self.bytes = [], [], [], [], {}, 0

    def add(self, id_: int | None, raw: bytes) -> None:
        words = terms_of(raw)
        if not words:
            return
        number = self.vocabulary.setdefault
        self.numbers.append(np.fromiter((number(w, len(self.vocabulary)) for w in words), np.int64, len(words)))
        self.ids.append(id_ or 0)
        self.known.append(id_ is not None)
        self.lengths.append(len(words))
        self.bytes += len(raw)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = sorted(self.vocabulary)
        place = np.empty(len(order), np.int64)
        place[[self.vocabulary[w] for w in order]] = np.arange(len(order))
        code, tf = np.unique(place[np.concatenate(self.numbers)] * len(lengths) + doc, return_counts=True)
        term, doc = np.divmod(code, len(lengths))
        m = 25 + (75 * lengths * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        offsets = np.searchsorted(term, np.arange(len(order) + 1))
        cell = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [cell(np.array(self.ids), np.int64), cell(np.array(self.known), np.bool_), pa.array([order], pa.list_(pa.binary())),
             cell(offsets, np.int64), cell(doc, np.int32), cell(impact, np.int32)],
            ["ids", "known", "terms", "offsets", "docs", "impacts"])


def build_shards(docs: DataFrame, id_col: str, text_col: str, n_docs: int, n_terms: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row a shard, as SHARDS; arrays are stored as their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for id_, raw in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                if raw.is_valid:
                    shard.add(id_.as_py(), raw.as_py())
                if shard.bytes >= shard_bytes:
                    yield shard.row(n_docs, n_terms)
                    shard = _Shard()
        if shard.ids:
            yield shard.row(n_docs, n_terms)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SHARDS)


def query_blocks(queries: DataFrame, id_col: str, text_col: str, most_items: int, most_chars: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Blocks of (id, terms with their repeats); the driver holds one at a time."""
    block, chars = [], 0
    for id_, text in queries.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        if block and (len(block) >= most_items or chars + len(text) > most_chars):
            yield block
            block, chars = [], 0
        if words := terms_of(text.encode()):
            block.append((id_, Counter(words)))
            chars += len(text)
    if block:
        yield block


def _frequencies(shards: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Document frequencies of a block's terms."""
    told = shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(told.value)}
        df = np.zeros(len(number), np.int64)
        for batch in batches:
            for terms, offsets in zip(batch.column(0), batch.column(1)):
                here = np.diff(np.frombuffer(offsets.as_py(), np.int64))
                for k, w in enumerate(terms.values.to_pylist()):
                    if (at := number.get(w)) is not None:
                        df[at] += here[k]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["number", "df"])

    found = shards.select("terms", "offsets").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))
    return {wanted[r["number"]]: r["df"] for r in found.collect()}  # the terms of a block


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
    """The places of the first `top` scores above 0, equal scores by known, then smaller id."""
    some = np.flatnonzero(scores > 0)
    if len(some) > top:
        had = scores[some]
        last = had[np.argpartition(had, len(had) - top)[len(had) - top]]
        over, tied = some[had > last], some[had == last]
        some = np.concatenate([over, tied[np.lexsort((ids[tied], ~known[tied]))[: top - len(over)]]])
    return some[np.lexsort((ids[some], ~known[some], -scores[some]))]


def _scored(shards: DataFrame, told, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = told.value
        wanted = [[(w, weights[w] * times) for w, times in words.items() if weights.get(w)] for _, words in block]
        none = np.zeros(0, np.int64)
        held = [(none, none, none.astype(bool))] * len(block)
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), kind)  # noqa: B023, E731
                ids, known, offsets, docs, impacts = cell("ids", np.int64), cell("known", np.bool_), cell("offsets", np.int64).tolist(), cell("docs", np.int32), cell("impacts", np.int32).astype(np.int64)
                at = {w: k for k, w in enumerate(batch.column("terms")[row].values.to_pylist())}
                total = np.zeros(len(ids), np.int64)
                for q, words in enumerate(wanted):
                    total[:] = 0
                    for w, weight in words:
                        k = at.get(w)
                        if k is not None:
                            total[docs[offsets[k] : offsets[k + 1]]] += weight * impacts[offsets[k] : offsets[k + 1]]
                    some = best(total, ids, known, top)
                    if len(some):
                        had = [np.concatenate(x) for x in zip(held[q], (total[some], ids[some], known[some]))]
                        first = best(*had, top)
                        held[q] = tuple(x[first] for x in had)
        n = [len(h[0]) for h in held]
        scores, ids, known = (np.concatenate(x) for x in zip(*held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(block)), n), pa.int64()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())], ["_query", "doc_id", "score"])

    return shards.mapInArrow(run, "_query long, doc_id long, score long")


def merged(found: DataFrame, top: int, pieces: int) -> DataFrame:
    """The first `top` rows a query by (score descending, doc_id, nulls last), with rank; first within pieces, so that no query's rows meet in one task."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    piece = F.pmod(F.xxhash64("doc_id", "score"), F.lit(pieces))
    some = found.withColumn("_piece", piece).withColumn("rank", F.row_number().over(W.partitionBy("_query", "_piece").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("_query").orderBy(*order))).filter(F.col("rank") <= top).drop("_piece")


def ranked_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
                  top: int = 10, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the best documents of each query."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    n_docs, n_terms = collection(docs, text_col)
    out = spark.createDataFrame([], schema).withColumnRenamed("item_id", query_id)
    if not n_terms:
        return out
    shards = saved(build_shards(docs, id_col, text_col, n_docs, n_terms, shard_bytes), "shards")
    for block in query_blocks(queries, query_id, query_text, block_items, block_chars):
        wanted = sorted(set().union(*(words for _, words in block)))
        df = _frequencies(shards, wanted)
        weights = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
        told = spark.sparkContext.broadcast((block, weights))
        found = merged(_scored(shards, told, top), top, shuffle_partitions(spark))
        names = F.broadcast(spark.createDataFrame([(k, id_) for k, (id_, _) in enumerate(block)], f"_query long, {query_id} long"))  # a block
        out = out.unionByName(saved(found.join(names, "_query").select(query_id, "rank", F.col("doc_id").alias("doc_id"), "score"), "ranked-rows"))
    dropped(shards)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
held AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, term),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
items AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM items) GROUP BY q, item_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, size GROUP BY term, n_docs),
scored AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (r), size GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
