"""Hybrid retrieval: embedders, match expressions, filters, and the plan from two retrievers to the final rows.

Embedders, scorers and graders are callables that a caller gives; the defaults here need no model.
An embedder takes a list of texts and returns a matrix, a row a text; a scorer takes a list of
queries and one of texts and returns a number for each; a grader does so with booleans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField

from docwright.batches import computed
from docwright.functions.text import first_date, terms
from docwright.operators import retrieval
from docwright.operators.match import matches
from docwright.session import own_name

DIM, CACHED = 64, 200_000
Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]
WORDS = re.compile(r"[^\W_]+")


class HashingEmbedder:
    """Words hashed to signed places and counted, of unit length; a text without words is all zero."""

    def __init__(self, size: int = DIM):
        self.size, self.known = size, {}

    def place(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            code = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
            got = self.known[word] = int(code[:7], 16) % self.size, 1 - 2 * (int(code[7], 16) & 1)
        return got

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in WORDS.findall(text.lower()):
                at, sign = self.place(word)
                row[at] += sign
        return normalized(out)


def normalized(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of token states (texts, tokens, size) where the mask holds, of unit length."""
    weight = mask[:, :, None].astype(float)
    return normalized((states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9))


def embedded(rows: DataFrame, id_col: str, text_col: str, embedder: Embedder | None = None, prefix: str = "", batch: int = 64) -> DataFrame:
    """(id, embedding): texts embedded `batch` at a time; null and blank texts, and those that embed to nothing, are left out."""
    embed = embedder or HashingEmbedder()

    def vectors(texts: list[str | None]) -> tuple[list]:
        out: list = [None] * len(texts)
        some = [k for k, t in enumerate(texts) if t is not None and t.strip()]
        for k in range(0, len(some), batch):
            part = some[k : k + batch]
            x = np.asarray(embed([prefix + texts[i] for i in part]), float)
            for i, row, any_ in zip(part, x, x.any(1)):
                out[i] = row if any_ else None
        return (out,)

    found = computed(rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), [F.col("text")], vectors, [StructField("embedding", ArrayType(DoubleType()))])
    return found.filter("embedding is not null").select("id", "embedding")


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """chunks with their embeddings; ValueError where the two don't have the same keys, one row each."""
    a, b = chunks.select(key), vectors.select(key)
    n, m = a.count(), b.count()
    if n != m or a.distinct().count() != n or b.distinct().count() != m or not a.join(b, key, "left_anti").isEmpty():
        raise ValueError(f"{n} chunks and {m} embeddings do not match one to one")
    return chunks.join(vectors, key)


def match_search(docs: DataFrame, text: Column, expression: str) -> DataFrame:
    """docs that satisfy the expression; where it is broken, those that hold each of its blank-separated words somewhere."""
    try:
        return docs.filter(matches(terms(text), expression))
    except ValueError:
        held = F.lit(True)
        for word in expression.lower().split():
            held = held & F.contains(F.lower(text), F.lit(word))
        return docs.filter(held)


def folded(text: Column) -> Column:
    """Lower case without accents on Latin letters, for summaries."""
    import unicodedata

    marked = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    plain = "".join(unicodedata.normalize("NFD", c)[0] for c in marked)
    return F.lower(F.translate(text, "".join(marked), plain))


def summary_search(summaries: DataFrame, query: str, kind: str | None = None, level: str | None = None) -> DataFrame:
    """Summaries (content, summary_type, summary_level) that hold every word of the query, accents aside."""
    words = terms(folded(F.col("content")))
    wanted = terms(folded(F.lit(query)))
    found = summaries.filter((F.size(wanted) > 0) & F.forall(wanted, lambda w: F.array_contains(words, w)))
    for column, value in (("summary_type", kind), ("summary_level", level)):
        found = found if value is None else found.filter(F.col(column) == value)
    return found


def selection(file_names: list[str] | None = None, document_type: str | None = None, file_col: str = "file_name", type_col: str = "document_type") -> Column | None:
    """The filter that both retrievers take, or None."""
    parts = [] if not file_names else [F.col(file_col).isin(*file_names)]
    parts += [] if document_type is None else [F.col(type_col) == document_type]
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def in_dates(rows: DataFrame, columns: list[str], first: str, last: str) -> DataFrame:
    """Rows whose first readable date among the columns lies in the inclusive range; undated rows stay."""
    day = F.coalesce(*[first_date(F.col(c)) for c in columns])
    return rows.filter(day.isNull() | day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def fetched(found: DataFrame, chunks: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """found with the columns of chunks by id; ids that chunks lacks come from the fallback."""
    met = found.join(chunks, "id")
    if fallback is None:
        return met
    missing = found.join(chunks.select("id"), "id", "left_anti")
    return met.unionByName(missing.join(fallback.select(*chunks.columns), "id"))


def overlap(queries: list[str], texts: list[str]) -> np.ndarray:
    """The share of a query's distinct words that the text holds."""
    words = [set(WORDS.findall(t.lower())) for t in texts]
    asked = [set(WORDS.findall(q.lower())) for q in queries]
    return np.array([len(a & w) / max(1, len(a)) for a, w in zip(asked, words)])


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def reranked(candidates: DataFrame, scorer: Scorer | None = None, most_chars: int = 512, batch: int = 32) -> DataFrame:
    """candidates (query_id, id, query, text, rank) with score and rank by the scorer's view of a text's first characters; ties keep their order."""
    score = scorer or overlap

    def scores(asked: list[str | None], texts: list[str | None]) -> tuple[np.ndarray]:
        asked, texts = [q or "" for q in asked], [(t or "")[:most_chars] for t in texts]
        got = [np.asarray(score(asked[k : k + batch], texts[k : k + batch]), float) for k in range(0, len(asked), batch)]
        return (np.round(np.concatenate([np.zeros(0), *got]), 6),)

    out = computed(candidates.drop("score"), [F.col("query"), F.col("text")], scores, [StructField("score", DoubleType())])
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "rank", "id")
    return out.withColumn("rank", F.row_number().over(by))


def graded(found: DataFrame, grader: Callable[[list[str], list[str]], list[bool]], batch: int = 5) -> DataFrame:
    """found (query, text) without the rows the grader turns down, `batch` at a time; a batch with an answer of the wrong size stays."""

    def keep(asked: list[str | None], texts: list[str | None]) -> tuple[list[bool]]:
        out: list[bool] = []
        for k in range(0, len(asked), batch):
            said = list(grader(asked[k : k + batch], texts[k : k + batch]))
            n = len(asked[k : k + batch])
            out += [bool(s) for s in said] if len(said) == n else [True] * n
        return (out,)

    mark = own_name(found, "_kept")
    return computed(found, [F.col("query"), F.col("text")], keep, [StructField(mark, BooleanType())]).filter(F.col(mark)).drop(mark)


@dataclass
class Settings:
    """How many rows each step takes; a threshold of None keeps all."""

    semantic: int = 50
    keyword: int = 50
    rerank: int = 25
    final: int = 15
    threshold: float | None = 0.15
    guaranteed: int = 3
    skip_rerank: bool = False
    balance: float | None = None  # of relevance against diversity; None leaves diversity out
    strict: bool = False  # filters by the threshold again, without the guaranteed rows
    query_prefix: str = ""  # what the embedder is told before a query
    dates: tuple[list[str], str, str] | None = None  # columns of chunks, first and last day; undated rows stay


def retrieve(chunks: DataFrame, queries: DataFrame, text_cols: list[str], settings: Settings = Settings(), where: Column | None = None,
             vectors: DataFrame | None = None, embedder: Embedder | None = None, scorer: Scorer | None = None, fallback: DataFrame | None = None,
             expand: Callable[[DataFrame], DataFrame] | None = None, grader: Callable[[list[str], list[str]], list[bool]] | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rrf_score, rank) from chunks (id, text, ...) and queries (query_id, text).

    `expand` gives the queries that the retrievers see, the given ones are what rows are scored and graded by. After the threshold, rows outside the
    dates go, then those that the grader turns down; ranks close up. With `summaries` and chunks' document_id each row has its document's overview.

    Nearest neighbours and BM25 over text_cols are fused by reciprocal ranks; the best are fetched and scored again on their
    first 512 characters. Rows under the threshold go, but for the first few; fused scores are on another scale and have no
    threshold. The filter applies to both retrievers, and before any limit.
    """
    s = settings
    rows = chunks if where is None else chunks.filter(where)
    known = vectors if vectors is not None else embedded(rows, "id", "text", embedder)
    if vectors is not None and where is not None:
        known = vectors.join(rows.select("id"), "id", "left_semi")
    wider = queries if expand is None else expand(queries)
    asked = embedded(wider, "query_id", "text", embedder, s.query_prefix).withColumnRenamed("id", "query_id")
    dense = retrieval.nearest(known, asked, s.semantic)
    sparse = retrieval.bm25_search(rows, "id", text_cols, wider, s.keyword)
    fused = retrieval.fuse(dense, sparse, s.rerank).select("query_id", "id", F.col("score").alias("rrf_score"), "rank")
    if s.skip_rerank:
        out = fused.withColumn("score", F.col("rrf_score"))
    else:
        full = fetched(fused, rows.select("id", "text"), fallback).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        out = reranked(full, scorer)
        if s.threshold is not None:
            out = retrieval.confident(out, s.threshold, 0 if s.strict else min(s.guaranteed, s.final))
    if s.dates is not None:
        columns, first, last = s.dates
        out = in_dates(out.join(rows.select("id", *[F.col(c).alias(f"_date{k}") for k, c in enumerate(columns)]), "id", "left"), [f"_date{k}" for k in range(len(columns))], first, last)
    if grader is not None:
        said = out.select("query_id", "id", "score", "rrf_score", "rank").join(rows.select("id", "text"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        out = graded(said, grader)
    if s.dates is not None or grader is not None:
        out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    out = _final(out, s, known, asked)
    if summaries is not None:
        out = with_overviews(out.join(rows.select("id", "document_id"), "id", "left"), summaries)
    return out


def _final(out: DataFrame, s: Settings, known: DataFrame, asked: DataFrame) -> DataFrame:
    """The first rows of each query, diverse ones if asked for."""
    if s.balance is not None:
        pairs = out.select("query_id", "id", "rrf_score", F.col("score").alias("relevance")).join(known, "id").join(asked.withColumnRenamed("embedding", "query_embedding"), "query_id")
        chosen = retrieval.diversified(pairs, s.final, s.balance).select("query_id", "id", "rank")
        return chosen.join(out.drop("rank"), ["query_id", "id"]).select("query_id", "id", "score", "rrf_score", "rank")
    return out.filter(F.col("rank") <= s.final).select("query_id", "id", "score", "rrf_score", "rank")


def provenance(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("semantic", "keyword")) -> DataFrame:
    """(query_id, id, sources): a map of each retriever that found the row to its score there."""
    rows = [df.select("query_id", "id", F.lit(n).alias("source"), F.col("score").cast("double").alias("score")) for df, n in zip((first, second), names)]
    both = rows[0].unionByName(rows[1]).filter("id is not null")
    return both.groupBy("query_id", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "score")))).alias("sources"))


def retrieval_stats(found: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, n, avg_score, min_score, max_score, n_files) of found (query_id, id, score) and files (id, file_name)."""
    met = found.join(files.select("id", "file_name"), "id", "left")
    return met.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.min("score").alias("min_score"),
                                       F.max("score").alias("max_score"), F.countDistinct("file_name").alias("n_files"))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """(query_id, stage, n): how many rows of each query came out of each stage, given by name."""
    rows = [df.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    return reduce(DataFrame.unionByName, rows)


def with_overviews(found: DataFrame, summaries: DataFrame, key: str = "document_id") -> DataFrame:
    """found with the content of its document's first overview (by summary_id), null where there is none."""
    first = F.row_number().over(W.partitionBy(key).orderBy("summary_id"))
    one = summaries.filter((F.col("summary_type") == "overview") & (F.col("summary_level") == "document")).withColumn("_n", first).filter("_n = 1")
    return found.join(one.select(key, F.col("content").alias("document_summary")), key, "left")


def summary_first(summaries: DataFrame, chunks: DataFrame, top: int, per_file: int) -> DataFrame:
    """(id, file_name, score): of the `top` summaries (file_name, score) the best `per_file` chunks (id, file_name, score) each; scores multiply, a chunk counts once with its best."""
    best = F.row_number().over(W.orderBy(F.desc("score"), "file_name"))  # a row a summary found
    files = summaries.select("file_name", "score").withColumn("_n", best).filter(F.col("_n") <= top)
    files = files.groupBy("file_name").agg(F.max("score").alias("_file_score"))
    nth = F.row_number().over(W.partitionBy("file_name").orderBy(F.desc("score"), "id"))
    some = chunks.join(F.broadcast(files), "file_name").withColumn("_n", nth).filter(F.col("_n") <= per_file)  # `top` files
    return some.groupBy("id", "file_name").agg(F.max(F.col("score") * F.col("_file_score")).alias("score"))
