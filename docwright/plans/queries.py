"""Queries of the engine's own operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.functions import text as T
from docwright.operators import chunking, citations as cites, classifier, evaluation, extraction, retrieval, search, tables
from docwright.session import table, task_partitions

def _benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d, top):
    return retrieval.bm25_search(table(spark, d, "documents"), "doc_id", ["source", "text", "lang"], _benchmark(spark, d), top)


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours and BM25 fused, the best reranked on their opening, with the threshold and its guaranteed rows."""
    chunks = table(spark, d, "documents").withColumn("id", F.col("doc_id"))
    found = search.retrieve(chunks, _benchmark(spark, d), ["source", "text", "lang"])
    return found.select("query_id", F.col("id").alias("doc_id"), "score", "rrf_score", "rank")


def _neighbours(spark, d, top):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), asked, top)


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, 10).select("query_id", F.col("id").alias("vec_id"), "distance", "score", "rank")


def vector_search_diversified(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = _neighbours(spark, d, 25).select("query_id", "id")
    full = near.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id")
    return retrieval.diversified(full, 10)


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    e = e.select(F.col("event_type").alias("query_id"), F.col("user_id").alias("id"), F.round("total", 4).alias("total"), "n")
    a = retrieval.ranked(e.withColumn("score", F.col("total")), 20)
    b = retrieval.ranked(e.withColumn("score", F.col("n")), 20)
    return retrieval.fuse(a, b, 10).select("query_id", "id", "score", "rank")


def refusals(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.refuses(_bm25(spark, d, 10), _benchmark(spark, d), 40.0)


def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.substring_search(table(spark, d, "documents"), "text", ["The", "eren"]).select("doc_id", "score")


def summary_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    groups = docs.groupBy(F.col("source").alias("group")).agg(F.count("*").cast("double").alias("group_score"))
    chunks = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return retrieval.summary_first(groups, chunks, 3).select("group", F.col("id").alias("doc_id"), "nth", "score")


def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.fixed_windows(table(spark, d, "documents"), "doc_id", "text", 1000, 200)
    return out.select(F.col("id").alias("doc_id"), "number", "chunk_id", "char_start", "char_end", F.md5("chunk").alias("chunk_md5"))


def paragraph_offsets(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.paragraphs(table(spark, d, "documents"), "doc_id", "text", r"\n")
    return out.select(F.col("id").alias("doc_id"), "paragraph", F.length("text").alias("n"), "char_start")


def adaptive_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.adaptive_chunks(table(spark, d, "documents"), "doc_id", "text", 1024 * 4, 512 * 4)
    return out.select(F.col("id").cast("long").alias("doc_id"), "chunk_id", "char_start", "char_end")


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce("lang", F.lit("unknown")).alias("kind")
    return table(spark, d, "documents").groupBy(kind).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("source").alias("files"))


def _recent(spark, d):
    """Events of the last seven days with tokens and rate as a log of model calls has them; null values are errors."""
    e = table(spark, d, "events")
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of"))), F.col("ts") > F.col("as_of") - F.expr("interval 7 days"))  # one row
    return recent.withColumns({"tokens": F.col("user_id") % 100, "error": F.when(F.col("event_type") == "error", F.lit("failed"))})


def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    good = _recent(spark, d).filter("error is null")
    got = good.groupBy("event_type", (F.col("user_id") % 5).alias("query_type")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.round(F.avg(F.col("tokens") / (F.col("value") + 1)), 6).alias("avg_rate"))
    return got.orderBy(F.desc("n"), "event_type", "query_type").limit(20)


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("models"), F.round(F.avg("value"), 6).alias("avg_value"), F.count("error").alias("errors"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return tables.percentiles(table(spark, d, "events"), "event_type", "value", 0.5, 0.95, 0.99)


def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return tables.top_and_other(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n")


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return extraction.entities(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "kind", "name", "confidence", "mentions")


def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    out = classifier.classified(table(spark, d, "documents"), "doc_id", "text", F.concat_ws("/", "source", "lang"))
    return out.select(F.col("id").alias("doc_id"), "kind", "score", F.round("confidence", 6).alias("confidence"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return extraction.year_headings(o, "o_custkey", "day", "o_orderkey")


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("l_linenumber", F.concat(F.lit("Said. [Source: part"), "l_partkey", F.lit(" | Page "), "l_linenumber", F.lit("] "))).alias("i")
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = lines.count() + 4 * part.count()
    said = lines.repartition(task_partitions(spark, rows), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["col2"]), "").alias("text"))
    found = cites.citations(said, "l_orderkey", "text")
    pages = part.filter("p_size >= 10").select(F.concat(F.lit("part"), "p_partkey").alias("file_name"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page_number"), F.lit(None).cast("int").alias("paragraph_number"))
    return cites.verified(found, pages, rows).select(F.col("id").alias("l_orderkey"), "n_citations", "n_missing", "verified")


def recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_partkey").alias("truth"), F.sort_array(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("s"), "l_partkey"))).alias("r"))
    got = F.transform("r", lambda x: x["l_partkey"])
    return rows.select("l_orderkey", F.round(evaluation.recall_at(got, F.col("truth"), 3), 6).alias("recall"))


def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return tables.batches(table(spark, d, "documents"), "source", "doc_id")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = docs.filter("doc_id % 10 = 0").select((F.col("doc_id") + 5).alias("doc_id"), F.lit("xx").alias("lang"), "n_chars")
    return tables.upsert(docs, new, "doc_id")


def deleted(spark: SparkSession, d: str) -> DataFrame:
    return tables.delete(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return tables.newest(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", F.desc("turn"), most=2)


def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    return tables.document_text(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_md5"))


def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("tokens", T.estimated_tokens(F.col("text")))
    return tables.with_budget(c, "conv_id", ["turn"], "tokens", 200).select("conv_id", "turn", "tokens", "used")


def text_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.safe_name(F.col("p_name")).alias("safe"), T.slug(F.col("p_name")).alias("slug"), T.preview(F.col("p_type"), 10).alias("short"), T.document_key(F.col("p_name")).alias("key"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(T.without_tags(F.col("html"))).alias("n"))


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    mapping = s.join(s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("new")), "s_nationkey").select(F.col("s_suppkey").alias("old"), "new")
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return tables.rekey(e, mapping, "source").groupBy("source").agg(F.count("*").alias("edges"), F.countDistinct("target").alias("targets"))


def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    shown = n.filter("source <> 'n3'").select(F.col("source").alias("node")).union(table(spark, d, "region").filter("r_regionkey < 3").select(F.concat(F.lit("r"), "r_regionkey")))
    return tables.induced(n, shown, "source", "target", "node")
