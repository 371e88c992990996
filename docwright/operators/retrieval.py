"""Retrieval: BM25, exact nearest neighbours, rank fusion, reranking, diversification, guards."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docwright.functions.text import terms
from docwright.session import saved

K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(id, term, tf, dl): the inverted index; a document's terms are counted where it stands, without a shuffle of all words."""
    words = terms(F.concat_ws(" ", *text_cols))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("words")).withColumn("dl", F.size("words").cast("long"))
    return rows.select("id", "dl", F.explode("words").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def _best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
    """The places of the first `top` by (score descending, id), null ids first, as Spark sorts them."""
    if len(ids) > top:
        some = np.flatnonzero(scores >= np.partition(scores, len(ids) - top)[len(ids) - top])
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], known[some], -scores[some]))[:top]]


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A long column's values, 0 for nulls, and which are known: pandas would turn them to floats."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _found(query_ids: pa.Array, at: list[np.ndarray], ids: pa.Array, rows: list[np.ndarray], values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A batch of (query_id, id, value) from places in the queries and in a batch of rows."""
    take = lambda column, places: column.take(pa.array(np.concatenate(places), pa.int64()))
    return pa.RecordBatch.from_arrays([take(query_ids, at), take(ids, rows), pa.array(np.concatenate(values), pa.float64())], names)


def bm25_search(docs: DataFrame, id_col: str, text_cols: list[str], queries: DataFrame, top: int = 10, most_queries: int = 256) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, text) over the concatenated columns.

    Queries go in blocks. For a block, one pass tokenises the documents and keeps the words asked for; from it
    come document frequencies, then scores: each batch of documents is a matrix of term weights, its product with the
    queries' terms scores all at once, and a batch gives its first `top` a query. No term is a key, so a frequent
    one makes no task large.
    """
    spark = docs.sparkSession
    words = terms(F.concat_ws(" ", *text_cols))
    schema = "query_id long, id long, score double"
    found = spark.createDataFrame([], schema)
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("w")).toLocalIterator()
    while block := list(islice(asked, most_queries)):
        wanted = sorted({t for r in block for t in r["w"]})
        if not wanted:
            continue
        rows = docs.select(F.col(id_col).cast("long").alias("id"), words.alias("words"))
        rows = saved(rows.select("id", F.size("words").cast("long").alias("dl"), F.filter("words", lambda w: w.isin(*wanted)).alias("words")), "hits")
        n, avg = rows.agg(F.count("*"), F.avg("dl")).first()
        df = dict(rows.select(F.explode(F.array_distinct("words")).alias("t")).groupBy("t").count().collect())  # the block's words
        idf = np.array([max(1e-6, math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))) for t in wanted])
        at = {t: k for k, t in enumerate(wanted)}
        needs = np.zeros((len(wanted), len(block)))
        for k, r in enumerate(block):
            needs[[at[t] for t in r["w"]], k] = 1
        found = found.union(_scored(rows, spark.sparkContext.broadcast(([r["query_id"] for r in block], at, idf, needs, float(avg or 1.0))), top, schema))
    return ranked(found.withColumn("score", F.round("score", 6)), top)


def _scored(rows: DataFrame, told, top: int, schema: str, step: int = 256) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, at, idf, needs, avg = told.value
        query_ids = pa.array(query_ids, pa.int64())
        asked = pa.array(list(at))
        for batch in batches:
            ids, known = _numbers(batch.column("id"))
            dl, words = _numbers(batch.column("dl"))[0], batch.column("words")
            scores = np.zeros((len(ids), needs.shape[1]))
            for k in range(0, len(ids), step):
                part = words.slice(k, step)  # words become numbers without being Python's strings
                tf = np.zeros((len(part), len(idf)))
                row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                np.add.at(tf, (row, pc.index_in(part.flatten(), value_set=asked).to_numpy(zero_copy_only=False)), 1)
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[k : k + step, None] / avg)) * idf
                scores[k : k + step] = weight @ needs
            places, rows_, values = [], [], []
            for q in range(len(query_ids)):
                some = np.flatnonzero(scores[:, q] > 0)
                first = some[_best(np.round(scores[some, q], 6), ids[some], known[some], top)]
                places.append(np.full(len(first), q))
                rows_.append(first)
                values.append(scores[first, q])
            if places:
                yield _found(query_ids, places, batch.column("id"), rows_, values, ["query_id", "id", "score"])

    return rows.mapInArrow(run, schema)


def ranked(found: DataFrame, top: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and matrices of at most `most` queries each; the driver holds one at a time."""
    rows = queries.select("query_id", "embedding").toLocalIterator()
    while some := list(islice(rows, most)):
        yield [r[0] for r in some], np.array([r[1] for r in some], np.float64)


def _first(exact: np.ndarray, ids: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
    """The positions that can be among the first `top` by (distance rounded to six places, id), however halves are rounded; null ids come first."""
    low, high = np.round(exact - 1e-9, 6), np.round(exact + 1e-9, 6)
    if len(ids) <= top:
        return np.arange(len(ids))
    last = np.lexsort((ids, known, high))[top - 1]
    after = (known & ~known[last]) | ((known == known[last]) & (ids > ids[last]))
    return np.flatnonzero(~(low > high[last]) & ~((low == high[last]) & after))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, where: Column | None = None, most_queries: int = 10_000) -> DataFrame:
    """(query_id, id, distance, score, rank): exact L2 neighbours of each query over all rows, in blocks.

    vectors (id, embedding); queries (query_id, embedding). Queries go in blocks of at most `most_queries`, with a
    scan of the vectors each. A batch of rows yields its first `top` rows a query by (rounded distance, id), so the
    final sort is small. Rows and queries without an embedding are left out.
    """
    rows = (vectors if where is None else vectors.filter(where)).filter("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    queries = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    schema = "query_id long, id long, distance double"

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, q = shared.value
            query_ids = pa.array(query_ids, pa.int64())
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, known = _numbers(batch.column("id"))
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).astype(np.float64)
                squares = (x**2).sum(1)
                for k in range(0, len(q), 256):
                    block = q[k : k + 256]
                    own_squares = (block**2).sum(1)[:, None]
                    rough = own_squares + squares - 2 * block @ x.T
                    # What rounding to six places or the rough distances may put before the last one stays.
                    error = 1e-11 * (own_squares + squares.max())
                    cut = np.partition(rough, min(top, len(x)) - 1, 1)[:, min(top, len(x)) - 1 : min(top, len(x))]
                    beyond = rough > (np.sqrt(np.maximum(cut, 0) + error) + 2e-6) ** 2 + error
                    places, taken, values = [], [], []
                    for i, gone in enumerate(beyond):
                        some = np.flatnonzero(~gone)
                        exact = np.sqrt(((x[some] - block[i]) ** 2).sum(1))
                        first = _first(exact, own[some], known[some], top)
                        places.append(np.full(len(first), k + i))
                        taken.append(some[first])
                        values.append(exact[first])
                    yield _found(query_ids, places, batch.column("id"), taken, values, ["query_id", "id", "distance"])

        return rows.mapInArrow(run, schema)

    near = vectors.sparkSession.createDataFrame([], schema)
    for block in _blocks(queries, most_queries):
        near = near.union(scan(vectors.sparkSession.sparkContext.broadcast(block)))
    near = near.withColumn("distance", F.round("distance", 6)).withColumn("score", F.round(1 / (1 + F.col("distance")), 6))
    by = W.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def fuse(first: DataFrame, second: DataFrame, top: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists; ties keep the first list's order, then the second's."""
    lists = first.select("query_id", "id", "rank", F.lit("a").alias("side")).unionByName(second.select("query_id", "id", "rank", F.lit("b").alias("side")))
    lists = lists.filter(F.col("id").isNotNull())
    got = lists.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"),
        F.min(F.when(F.col("side") == "a", F.col("rank"))).alias("rank_a"), F.min(F.when(F.col("side") == "b", F.col("rank"))).alias("rank_b"))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("rank_a"), F.asc_nulls_last("rank_b"), "id")
    return got.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def confident(found: DataFrame, threshold: float, least: int = 3) -> DataFrame:
    """Rows at or over the threshold, and the first `least` of each query in any case."""
    return found.filter((F.col("score") >= threshold) | (F.col("rank") <= least))


def refuses(found: DataFrame, queries: DataFrame, threshold: float, floor: float = 0.1) -> DataFrame:
    """(query_id, refuse): nothing found, or scores on a real scale of which none reaches the threshold."""
    best = found.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce((F.col("best") >= floor) & (F.col("best") < threshold), F.lit(True)).alias("refuse"))


def diversified(candidates: DataFrame, top: int, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within each query over (query_id, id, query_embedding, embedding); candidates are a bounded top-k."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["embedding"].notna() & frame["query_embedding"].notna()].sort_values("id").reset_index(drop=True)
        if not len(frame):
            return pd.DataFrame({"query_id": [], "id": [], "score": [], "rank": []})
        x = np.stack(frame["embedding"].to_list()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        q = np.asarray(frame["query_embedding"][0], np.float64)
        near = x @ (q / (np.linalg.norm(q) + 1e-9))
        chosen, closest, values = [], np.zeros(len(x)), []
        for _ in range(min(top, len(x))):
            value = balance * near - (1 - balance) * closest
            value[chosen] = -np.inf
            best = int(np.argmax(np.round(value, 9)))
            chosen.append(best)
            values.append(round(float(value[best]), 6))
            like = x @ x[best]
            closest = like if len(chosen) == 1 else np.maximum(closest, like)
        return pd.DataFrame({"query_id": frame["query_id"][chosen].to_numpy(), "id": frame["id"][chosen].to_numpy(), "score": values, "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, id long, score double, rank int")


def summary_first(groups: DataFrame, chunks: DataFrame, per_group: int) -> DataFrame:
    """The best chunks (group, id, score) within each chosen group (group, group_score); scores multiply."""
    by = W.partitionBy("group").orderBy(F.desc("score"), "id")
    best = chunks.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= per_group)
    return best.join(groups, "group").withColumn("score", F.col("score") * F.col("group_score"))


def substring_search(docs: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """Every word a case-insensitive substring; score 1."""
    held = F.lit(True)
    for w in words:
        held = held & F.contains(F.lower(F.col(text_col)), F.lit(w.lower()))
    return docs.filter(held).withColumn("score", F.lit(1.0))
