"""A positional index in segments, and the plan from a match expression to its postings.

A posting is (term, id, segment, positions), sorted by term and id and cut into ranges of both, so that a file's
statistics leave out the terms not asked for and a term of most documents is in many files. Documents
(id, dl) are a table in segments: an update writes the new documents' postings only, and a posting counts if its segment is the one that
counts for its document; only documents that deltas touch are looked up.

A match expression reads the postings of its terms and beginnings, once: they are grouped by document, where a phrase is the
intersection of its terms' positions less their place in it, and the expression is a column over the phrases. No text is read. Ranks are BM25 over
the expression's phrases.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwright.functions.text import terms
from docwright.operators import segments
from docwright.operators.match import Phrase, holds, parse, phrases
from docwright.operators.retrieval import B, K1
from docwright.session import shuffle_partitions

LAST = "\U0010ffff"


def write(spark: SparkSession, folder: str, docs: DataFrame, id_col: str, text_cols: list[str], order: str | None = None) -> None:
    """Index new documents or new versions of old ones. The order column, if any, is as for segments."""
    words = docs.select(F.col(id_col).cast("long").alias("id"), terms(F.concat_ws(" ", *text_cols)).alias("words"), *([F.col(order).alias("at")] if order else []))
    known = words.withColumn("dl", F.size("words").cast("long")).withColumn("mark", F.xxhash64("words"))
    batch = segments.write(spark, f"{folder}/docs", known.drop("words"), "id", "at" if order else None)
    rows = known.select("id", "words").mapInArrow(_in_place, "term string, id long, positions array<int>")
    rows = rows.repartitionByRange(shuffle_partitions(spark), "term", "id").sortWithinPartitions("term", "id")
    rows.withColumn("segment", F.lit(batch).cast("long")).write.parquet(f"{folder}/postings/batch={batch}-{uuid.uuid4().hex}")


def _in_place(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The postings of each document where it stands, about `most` words at a time, so that no word is shuffled by itself."""
    for batch in batches:
        lengths = batch.column("words").value_lengths().to_numpy(zero_copy_only=False)
        group = (np.cumsum(lengths) - lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            n = lengths[start:stop].astype(np.int64)
            coded = batch.column("words").slice(start, stop - start).flatten().dictionary_encode()
            row = np.repeat(np.arange(stop - start), n)
            key = coded.indices.to_numpy().astype(np.int64) << 32 | row
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[order]))
            ids = batch.column("id").slice(start, stop - start).take(pa.array(key[first] & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key[first] >> 32)), ids, positions], names=["term", "id", "positions"])


def erase(spark: SparkSession, folder: str, gone: DataFrame, id_col: str) -> None:
    segments.erase(spark, f"{folder}/docs", gone.select(F.col(id_col).cast("long").alias("id")))


def _live(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """rows (id, segment, ...) of the document versions that count."""
    changed = segments.touched(spark, f"{folder}/docs")
    if changed is None:
        return rows
    changed = changed.select(F.col("id").alias("_id"), F.col("_segment").alias("_at"), F.lit(True).alias("_changed"))
    met = rows.join(changed, F.col("id").eqNullSafe(F.col("_id")), "left")
    return met.filter("_changed is null or segment = _at").drop("_id", "_at", "_changed")


def postings(spark: SparkSession, folder: str, where: Column) -> DataFrame:
    """(term, id, positions) of live documents whose terms satisfy the filter, which reaches the files' statistics."""
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/postings").filter(where)
    return _live(spark, folder, found)


def compact(spark: SparkSession, folder: str) -> None:
    """One base of documents and one set of postings, live ones only."""
    live = postings(spark, folder, F.lit(True)).withColumn("segment", F.lit(0).cast("long"))
    path = f"{folder}/postings-{uuid.uuid4().hex}"
    live.repartitionByRange(shuffle_partitions(spark), "term", "id").sortWithinPartitions("term", "id").write.parquet(path)
    segments.compact(spark, f"{folder}/docs")
    fs, old = segments._fs(spark, f"{folder}/postings")
    fs.delete(old, True)
    fs.rename(segments._fs(spark, path)[1], old)


def _asked(found: list[Phrase]) -> Column:
    """The filter for every term and beginning."""
    slots = {s for p in found for s in p.slots}
    plain = sorted(t for t, begins in slots if not begins)
    parts = [F.col("term").isin(*plain)] if plain else []
    parts += [(F.col("term") >= t) & (F.col("term") < t + LAST) for t, begins in sorted(slots) if begins]
    return reduce(lambda a, b: a | b, parts)


def _is(slot: tuple[str, bool]) -> Column:
    term, begins = slot
    return F.startswith("term", F.lit(term)) if begins else F.col("term") == term


def match(spark: SparkSession, folder: str, expression: str) -> DataFrame:
    """(id, hits): documents that satisfy the expression, and how often each phrase, in order, is in them; ValueError for a broken one."""
    node = parse(expression)
    found = phrases(node)
    if not found:
        return spark.createDataFrame([], "id long, hits array<int>")
    slots = list(dict.fromkeys(s for p in found for s in p.slots))
    rows = postings(spark, folder, _asked(found))
    places = [F.array_distinct(F.flatten(F.collect_list(F.when(_is(s), F.col("positions"))))).alias(f"_p{k}") for k, s in enumerate(slots)]
    held = rows.groupBy("id").agg(*places)

    def back(slot: tuple[str, bool], k: int) -> Column:
        return F.transform(f"_p{slots.index(slot)}", lambda x: x - k)

    def starts(p: Phrase) -> Column:
        own = [back(s, k) for k, s in enumerate(p.slots)]
        return reduce(F.array_intersect, own) if len(own) > 1 else own[0]

    held = held.select("id", F.array(*[F.size(starts(p)) for p in found]).alias("hits"))
    return held.filter(holds(node, lambda p: F.get("hits", F.lit(found.index(p))) > 0))


def ranked_match(spark: SparkSession, folder: str, expression: str, top: int | None = None) -> DataFrame:
    """(id, score): matches by BM25 over the expression's phrases, each counted as a term; best first."""
    found = phrases(parse(expression))
    rows = match(spark, folder, expression)
    docs = segments.read(spark, f"{folder}/docs").select("id", "dl")
    n, avg = docs.agg(F.count("*"), F.avg("dl")).first()
    # A phrase's frequency is over all documents, so it is counted before the expression is.
    all_hits = match(spark, folder, " OR ".join(_said(p) for p in found)) if found else rows
    df = all_hits.agg(*[F.count_if(F.get("hits", F.lit(k)) > 0).alias(f"d{k}") for k in range(len(found))]).first() if found else []
    rows = rows.join(docs, "id")
    parts = [F.lit(0.0)]
    for k, d in enumerate(df):
        idf = F.greatest(F.lit(1e-6), F.log(F.lit((n - d + 0.5) / (d + 0.5))))
        tf = F.get("hits", F.lit(k))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(avg or 1)))))
    out = rows.select("id", F.round(reduce(lambda a, b: a + b, parts), 6).alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "id").limit(top)


def _said(p: Phrase) -> str:
    return " + ".join(f'"{t}"' + ("*" if begins else "") for t, begins in p.slots)
