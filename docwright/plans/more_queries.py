"""Queries of stores, prompts, catalogs, filters and extraction over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.functions import text as T
from docwright.operators import blocks, catalogs, citations as cites, cooccurrence, evaluation, graph, neighbours, parties, positions, prompts, retrieval, search, segments, store, tables
from docwright.plans.oracle import SQL as OTHERS, TERMS
from docwright.plans.queries import _benchmark
from docwright.session import shared_dir, table, task_partitions

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark, name):
    import uuid

    return f"{shared_dir(spark)}/docwright-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@_query("""SELECT s_suppkey AS id, 'person' AS type, x AS name, 'sender' AS role FROM (SELECT s_suppkey, unnest(['s' || s_suppkey || '@a.org', 'x@b.org']) AS x FROM supplier WHERE s_nationkey % 2 = 0)
UNION ALL SELECT s_suppkey, 'person', s_name, 'author' FROM supplier UNION ALL SELECT s_suppkey, 'person', 'A ' || s_nationkey, 'claimant' FROM supplier UNION ALL SELECT s_suppkey, 'person', 'B', 'defendant' FROM supplier
UNION ALL SELECT s_suppkey, 'case_ref', 'C' || s_suppkey, NULL FROM supplier""")
def metadata_entities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    meta = F.create_map(F.lit("from"), F.concat(F.lit("s"), "s_suppkey", F.lit("@a.org, x@b.org,")), F.lit("author"), F.col("s_name"), F.lit("parties"), F.concat(F.lit("A "), "s_nationkey", F.lit(" V. B")).cast("string"), F.lit("case_number"), F.concat(F.lit("C"), "s_suppkey"))
    meta = F.map_concat(F.map_filter(meta, lambda k, v: k != "parties"), F.create_map(F.lit("parties"), F.concat(F.lit("A "), "s_nationkey", F.lit(" v B"))))
    docs = s.select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "email").otherwise("letter").alias("kind"), meta.alias("metadata"))
    return parties.metadata_entities(docs, "s_suppkey").select("id", "type", "name", "role")


@_query("""SELECT n_nationkey AS id, n_name AS source, r_name AS target, n_nationkey AS source_id, 100 + r_regionkey AS target_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0""")
def relations_resolved(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    none = F.array().cast("array<string>")
    known = n.select(F.col("n_nationkey").alias("entity_id"), F.lower("n_name").alias("name"), none.alias("aliases")).unionByName(r.select((F.col("r_regionkey") + 100).alias("entity_id"), F.lit("zone").alias("name"), F.array("r_name").alias("aliases")))
    rel = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "nowhere").otherwise(F.col("n_name")).alias("source"), F.col("r_name").alias("target"))
    return parties.related(rel, known)


@_query("""WITH s AS (SELECT s_suppkey, s_name, s_nationkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS new FROM supplier)
SELECT new AS entity_id, arg_min(s_name, s_suppkey) AS name, count(*) - 1 AS n_aliases, count(*) AS n_chunks, arg_min(s_suppkey, s_suppkey)::VARCHAR AS first_key, max(s_suppkey)::VARCHAR AS last_key FROM s GROUP BY new""")
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    e = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("s_suppkey") >= 0, F.create_map(F.lit("own"), F.col("s_suppkey").cast("string"))).alias("metadata"), F.array(F.concat(F.lit("c"), "s_suppkey")).alias("source_chunks"))
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("new"))
    m = s.join(first, "s_nationkey").select(F.col("s_suppkey").alias("old"), "new")
    e = e.withColumn("metadata", F.map_concat("metadata", F.create_map(F.concat(F.lit("k"), "entity_id"), F.lit("1"))))
    got = parties.merged_entities(e, m)
    last = F.array_max(F.transform(F.filter(F.map_keys("metadata"), lambda k: F.startswith(k, F.lit("k"))), lambda k: F.substring(k, 2, 20).cast("long"))).cast("string")
    return got.select("entity_id", "name", F.size("aliases").cast("long").alias("n_aliases"), F.size("source_chunks").cast("long").alias("n_chunks"), F.element_at("metadata", "own").alias("first_key"), last.alias("last_key"))


@_query()
def entities_linked_or_created(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    asked = s.select(F.col("s_nationkey").cast("string").alias("type"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Quite Other "), "s_suppkey")).otherwise(F.upper("s_name")).alias("name"))
    known = s.filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").cast("string").alias("type"), F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return parties.linked_or_created(asked, known)


_SAID = "string_agg(CASE WHEN l_returnflag = 'N' THEN 'Line ' || l_linenumber || ' came back late. ' ELSE 'Line ' || l_linenumber || ' is here [source:part' || l_partkey || '|Page ' || l_linenumber || ']. ' END, '')"


@_query("""WITH c AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag <> 'N') AS n_citations,
count(*) FILTER (WHERE l_returnflag <> 'N' AND (p.p_partkey IS NULL OR p_size < 10 OR l_linenumber > 4)) AS n_missing, count(*) FILTER (WHERE l_returnflag = 'N') AS n_uncited FROM lineitem LEFT JOIN part p ON l_partkey = p_partkey GROUP BY 1)
SELECT *, n_missing = 0 AND n_uncited = 0 AS verified FROM c""")
def citations_verified(spark: SparkSession, d: str) -> DataFrame:
    """Responses with cited and bare sentences; of two chunks at one place the later, of a low score, would be left out and the earlier counts."""
    line = F.col("l_linenumber")
    said = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Line "), line, F.lit(" of this order came back late. "))).otherwise(F.concat(F.lit("Line "), line, F.lit(" is here [source:part"), "l_partkey", F.lit("|Page "), line, F.lit("]. ")))
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = lines.count() + 8 * part.count()
    texts = lines.repartition(task_partitions(spark, rows), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", said.alias("s")))), lambda x: x["s"]), "").alias("text"))
    pages = part.select(F.concat(F.lit("part"), "p_partkey").alias("file_name"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page_number"), F.lit(None).cast("int").alias("paragraph_number"), F.col("p_partkey").cast("string").alias("chunk_id"), F.when(F.col("p_size") >= 10, 0.9).otherwise(0.2).alias("score"))
    chunks = pages.withColumn("position", F.lit(1)).unionByName(pages.withColumn("position", F.lit(2)).withColumn("score", F.lit(0.1)))
    return cites.verify(texts, "l_orderkey", "text", chunks, rows=rows)


@_query("""SELECT l_orderkey AS id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS position, l_linenumber AS source_id, CASE WHEN l_linenumber <= 3 THEN 'c' || l_linenumber END AS chunk_id FROM lineitem""")
def inline_citations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    texts = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("So [[@source-"), n, F.lit("]]. "))), "").alias("text"))
    sources = li.select(F.col("l_orderkey").alias("id")).distinct().withColumn("source_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("chunk_id", F.concat(F.lit("c"), "source_id"))
    return cites.inline_citations(texts, "l_orderkey", "text", sources)


def _cited(d_spark, d):
    p = table(d_spark, d, "part")
    return p.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("rank"), F.concat(F.lit("f"), F.col("p_partkey") % 3).alias("file_name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3).alias("page_number"),
                    F.when(F.col("p_size") % 2 > 0, F.lit(7)).alias("paragraph_number"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("section_header"), F.col("p_name").alias("text"),
                    F.when(F.col("p_brand").endswith("1") & (F.col("p_partkey") % 3 == 0), F.lit("About f0")).alias("document_summary"))


_CITED = """WITH c AS (SELECT p_brand AS query_id, p_partkey AS rank, 'f' || p_partkey % 3 AS file_name, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS page, CASE WHEN p_size % 2 > 0 THEN 7 END AS para, CASE WHEN p_size % 5 = 0 THEN p_type END AS section, p_name AS text,
CASE WHEN ends_with(p_brand, '1') AND p_partkey % 3 = 0 THEN 'About f0' END AS summary FROM part),
s AS (SELECT *, concat_ws(' | ', file_name, 'Page ' || page, CASE WHEN page > 0 THEN 'Para ' || para END, '"' || section || '"') AS tag FROM c)"""


@_query(_CITED + """, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, file_name, page, para ORDER BY rank) = 1)
SELECT query_id, md5(string_agg('[Source: ' || tag || ']', chr(10) ORDER BY rank)) AS list_md5 FROM f GROUP BY 1""")
def source_lists(spark: SparkSession, d: str) -> DataFrame:
    return prompts.source_list(_cited(spark, d), "query_id", "rank").select("query_id", F.md5("text").alias("list_md5"))


@_query(_CITED + """, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM s)
SELECT query_id, md5(string_agg('[Source-' || k || ': ' || tag || ']', chr(10) ORDER BY k)) AS list_md5 FROM n GROUP BY 1""")
def numbered_source_lists(spark: SparkSession, d: str) -> DataFrame:
    return prompts.numbered_source_list(_cited(spark, d), "query_id", "rank").select("query_id", F.md5("text").alias("list_md5"))


@_query(_CITED + """, b AS (SELECT *, '[Source: ' || tag || ']' || chr(10) || text || chr(10) AS body, min(rank) OVER (PARTITION BY query_id, file_name) AS top, bool_or(summary IS NOT NULL) OVER (PARTITION BY query_id) AS gathered FROM s),
h AS (SELECT *, CASE WHEN gathered AND rank = top AND summary IS NOT NULL THEN '=== Document: ' || file_name || ' ===' || chr(10) || '[Document Overview]' || chr(10) || summary || chr(10) || chr(10) || body ELSE body END AS piece FROM b)
SELECT query_id, md5(CASE WHEN any_value(gathered) THEN string_agg(piece, chr(10) ORDER BY top, rank) ELSE string_agg(piece, chr(10) || chr(10) ORDER BY rank) END) AS prompt_md5 FROM h GROUP BY 1""")
def prompts_built(spark: SparkSession, d: str) -> DataFrame:
    return prompts.prompts(_cited(spark, d), "query_id", "rank").select("query_id", F.md5("text").alias("prompt_md5"))


@_query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'summary: ' || p_name WHEN 1 THEN 'Therefore: ' || p_name WHEN 2 THEN 'd' || chr(10) || chr(10) || p_name ELSE p_name END AS answer,
CASE p_size % 4 WHEN 0 THEN 'x' || chr(10) || 'Summary: old' || chr(10) || p_brand WHEN 1 THEN p_brand WHEN 2 THEN 'a' || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || 'c' ELSE '' END AS reasoning FROM part""")
def synthesis_split(spark: SparkSession, d: str) -> DataFrame:
    p, n = table(spark, d, "part"), F.col("p_size") % 4
    said = F.when(n == 0, F.concat(F.lit("x\nSummary: old\n"), "p_brand", F.lit("\nsummary: "), "p_name")).when(n == 1, F.concat("p_brand", F.lit("\nTherefore: "), "p_name", F.lit(" "))).when(n == 2, F.concat(F.lit("a\n\nb\n\n c\n\nd\n\n"), "p_name")).otherwise(F.col("p_name"))
    return p.select("p_partkey", prompts.synthesis(said).alias("s")).select("p_partkey", "s.*")


@_query("""WITH b AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, md5(string_agg('Batch ' || (turn + 1) || '/' || total || ' (chunks ' || (8 * turn + 1) || '-' || (8 * turn + 8) || ')' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn)) AS text_md5
FROM b WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1""")
def batch_outputs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumns({"first": F.col("turn") * 8 + 1, "last": F.col("turn") * 8 + 8})
    return prompts.batch_outputs(c, "conv_id", "turn", "text", "first", "last").select("conv_id", F.md5("text").alias("text_md5"))


@_query("""SELECT conv_id, count(*) AS batches, nullif(sum(turn), 0)::BIGINT AS prompt_tokens, nullif(sum(turn * 2), 0)::BIGINT AS prompt_ms, sum(greatest(1, length(coalesce(text, '')) // 4))::BIGINT AS tokens,
round(sum(greatest(1, length(coalesce(text, '')) // 4)) / nullif(sum(turn * 100) / 1000.0::DOUBLE, 0), 6) AS tokens_per_second FROM conversations GROUP BY 1""")
def batch_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("prompt_tokens"), (F.col("turn") * 2).alias("prompt_ms"), F.col("text").alias("answer"), (F.col("turn") * 100).alias("duration_ms"))
    return prompts.batch_stats(c, "conv_id")


_HOLDS = TERMS.format("text")


@_query(f"""WITH t AS (SELECT doc_id, {_HOLDS} AS w FROM documents)
SELECT doc_id FROM t WHERE (list_contains(w, 'the') AND len([x FOR x IN w IF starts_with(x, 'eren')]) > 0) OR (list_contains(w, 'und') AND NOT list_contains(w, 'der')) OR contains(' ' || array_to_string(w, ' ') || ' ', ' de la ')""")
def match_expressions(spark: SparkSession, d: str) -> DataFrame:
    return search.match_search(table(spark, d, "documents"), F.col("text"), '(the AND eren*) OR (und NOT der) OR "de la"').select("doc_id")


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'and,') AND contains(lower(text), 'the')")
def broken_match(spark: SparkSession, d: str) -> DataFrame:
    """A sign outside quotes is no expression: each blank-separated word is looked for as it stands."""
    return search.match_search(table(spark, d, "documents"), F.col("text"), "and, the").select("doc_id")


@_query(f"""WITH b AS (SELECT doc_id, source, lang, text FROM documents WHERE lang = 'en' AND source IN (SELECT min(source) FROM documents UNION SELECT max(source) FROM documents)),
tok AS (SELECT doc_id, {TERMS.format('text')} AS w FROM b), stat AS (SELECT count(*) AS n, avg(len(w)) AS adl FROM tok), post AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM post GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS.format('text')})) AS term FROM benchmark),
m AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / adl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), stat GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM m QUALIFY rank <= 5""")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ends = docs.agg(F.min("source"), F.max("source")).first()
    where = search.selection(list(ends), "en", "source", "lang")
    return retrieval.bm25_search(docs.filter(where), "doc_id", ["text"], _benchmark(spark, d), 5).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@_query("""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.label % 2 = 0)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d QUALIFY rank <= 5""")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.nearest(e.select(F.col("vec_id").alias("id"), "embedding", "label"), asked, 5, F.col("label") % 2 == 0)
    return found.select("query_id", F.col("id").alias("vec_id"), "distance", "rank")


def _lists(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("id")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").cast("double").alias("n"))
    return retrieval.ranked(e.withColumn("score", F.col("total")), 20), retrieval.ranked(e.withColumn("score", F.col("n")), 20)


_LISTS = """WITH e AS (SELECT event_type AS query_id, user_id AS id, round(sum(value), 4) AS total, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
a AS (SELECT query_id, id, total AS score FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) <= 20), b AS (SELECT query_id, id, n AS score FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) <= 20)"""


@_query(_LISTS + " SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, b.score AS keyword, a.score AS semantic FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id")
def rank_provenance(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.try_element_at("sources", F.lit(k)).alias(k)
    return search.provenance(*_lists(spark, d)).select("query_id", "id", at("keyword"), at("semantic"))


@_query(_LISTS + " SELECT query_id, count(*) AS n, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(DISTINCT id % 3) AS n_files FROM a GROUP BY 1")
def retrieval_statistics(spark: SparkSession, d: str) -> DataFrame:
    first, _ = _lists(spark, d)
    files = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().withColumn("file_name", F.col("id") % 3)
    return search.retrieval_stats(first, files)


@_query(_LISTS + " SELECT query_id, id, CASE WHEN id % 2 = 0 THEN 'main' ELSE 'second' END AS text FROM a WHERE id % 2 = 0 OR id % 3 > 0")
def chunks_fetched(spark: SparkSession, d: str) -> DataFrame:
    first, _ = _lists(spark, d)
    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    main = ids.filter("id % 2 = 0").withColumn("text", F.lit("main"))
    return search.fetched(first.select("query_id", "id"), main, ids.filter("id % 3 > 0").withColumn("text", F.lit("second"))).select("query_id", "id", "text")


@_query("""SELECT o_orderkey FROM orders WHERE CASE o_orderkey % 4 WHEN 0 THEN true WHEN 3 THEN o_custkey % 2 = 0 ELSE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' END""")
def date_filter(spark: SparkSession, d: str) -> DataFrame:
    """Dates in two spellings, none, or only in the second column."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    first = F.when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "d MMMM yyyy")).when(k == 3, F.lit("no date"))
    second = F.when(k == 3, F.when(F.col("o_custkey") % 2 == 0, "1995-06-30").otherwise("1.2.1990"))
    return search.in_dates(o.select("o_orderkey", first.alias("document_date"), second.alias("date")), ["document_date", "date"], "1995-01-01", "1995-12-31").select("o_orderkey")


_SUMS = "SELECT conv_id AS document_id, conv_id || ':' || turn AS summary_id, CASE turn % 3 WHEN 0 THEN 'overview' WHEN 1 THEN 'key_points' ELSE 'entities' END AS summary_type, CASE WHEN turn < 3 THEN 'document' ELSE 'section' END AS summary_level, text AS content, turn FROM conversations"


def _summaries(spark, d):
    t = F.col("turn")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.concat_ws(":", "conv_id", "turn").alias("summary_id"), F.when(t % 3 == 0, "overview").when(t % 3 == 1, "key_points").otherwise("entities").alias("summary_type"),
                                                   F.when(t < 3, "document").otherwise("section").alias("summary_level"), F.col("text").alias("content"), "turn")


@_query(f"""WITH s AS ({_SUMS}) SELECT 'all' AS part, NULL AS value, count(*) AS n, count(DISTINCT document_id) AS documents FROM s
UNION ALL SELECT 'type', summary_type, count(*), count(DISTINCT document_id) FROM s GROUP BY 2 UNION ALL SELECT 'level', summary_level, count(*), count(DISTINCT document_id) FROM s GROUP BY 2""")
def summary_statistics(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.summary_stats(_summaries(spark, d))


@_query(f"""WITH s AS ({_SUMS}), t AS (SELECT *, {TERMS.format('strip_accents(content)')} AS w FROM s) SELECT summary_id FROM t WHERE summary_level = 'document' AND list_contains(w, 'the') AND list_contains(w, 'and')""")
def summary_search(spark: SparkSession, d: str) -> DataFrame:
    return search.summary_search(_summaries(spark, d), "The, ánd", level="document").select("summary_id")


@_query(f"""WITH s AS ({_SUMS}), o AS (SELECT * FROM s WHERE summary_type = 'overview' AND summary_level = 'document' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY summary_id) = 1)
SELECT doc_id, md5(o.content) AS summary_md5 FROM documents LEFT JOIN o ON doc_id = document_id""")
def with_overviews(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("document_id"))
    return search.with_overviews(docs, _summaries(spark, d)).select("doc_id", F.md5("document_summary").alias("summary_md5"))


@_query(f"""WITH g AS (SELECT source AS file_name, count(*)::DOUBLE AS s FROM documents GROUP BY 1 ORDER BY s DESC, 1 LIMIT 3), r AS (SELECT source, doc_id, n_chars::DOUBLE AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2)
SELECT doc_id AS id, file_name, score * s AS score FROM r JOIN g ON source = file_name""")
def summary_first_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    summaries = docs.groupBy(F.col("source").alias("file_name")).agg(F.count("*").cast("double").alias("score"))
    return search.summary_first(summaries, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), F.col("n_chars").cast("double").alias("score")), 3, 2)


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def without_summaries(spark: SparkSession, d: str) -> DataFrame:
    return tables.delete(table(spark, d, "documents").select("doc_id"), table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id")


@_query("""WITH c AS (SELECT conv_id AS id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), p AS (SELECT id, coalesce(sum(n + 2) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start, n, k::INT AS page, turn::INT AS paragraph FROM c WHERE id % 3 = 0),
l AS (SELECT conv_id AS id, sum(length(coalesce(text, '')) + 2)::INT - 2 AS n, count(*)::INT AS c FROM conversations GROUP BY 1), s AS (SELECT id, n, c, ceil(n / c)::INT AS step, unnest(range(c))::INT AS i FROM l WHERE id % 3 = 1)
SELECT id, char_start, (char_start + n)::INT AS char_end, page, paragraph FROM p UNION ALL SELECT id, (i * step)::INT, least((i + 1) * step, n)::INT, i + 1, NULL FROM s UNION ALL SELECT id, 0, n, 1, NULL FROM l WHERE id % 3 = 2""")
def text_segments(spark: SparkSession, d: str) -> DataFrame:
    nth = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x, i: F.struct(x["text"].alias("text"), (i + 1).alias("page"), x["turn"].cast("int").alias("paragraph")))
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(nth.alias("all"))
    docs = docs.select("conv_id", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"), F.when(F.col("conv_id") % 3 == 0, F.col("all")).alias("paragraphs"), F.when(F.col("conv_id") % 3 == 1, F.transform("all", lambda x: x["page"])).alias("pages"))
    return prompts.segments(docs, "conv_id", "text", "paragraphs", "pages")


@_query("""WITH t AS (SELECT l_orderkey AS page, l_linenumber * 10000000 + l_partkey AS k, 'w' || l_partkey AS text, max(l_quantity) * 3 AS conf, (l_linenumber // 3) * 10 AS top FROM lineitem GROUP BY ALL), g AS (SELECT *, CASE WHEN top > lag(top) OVER (PARTITION BY page ORDER BY k) + 4 THEN 1 ELSE 0 END AS b FROM t WHERE conf >= 60),
l AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY k)::INT AS line FROM g), bad AS (SELECT page, count(*) FILTER (WHERE conf < 60) AS low FROM t GROUP BY 1) SELECT page, line, string_agg(text, ' ' ORDER BY k) AS text, any_value(low) AS low FROM l JOIN bad USING (page) GROUP BY 1, 2""")
def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("l_quantity"))
    t = t.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("k"), F.concat(F.lit("w"), "l_partkey").alias("text"), (F.col("l_quantity") * 3).alias("conf"), (F.floor(F.col("l_linenumber") / 3) * 10).alias("top"), F.lit(8).alias("height"))
    return catalogs.ocr_lines(t, "page", "k")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@_query(OTHERS["vector_search"])
def neighbours_index(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours from the stored cells: those that the bound rules out are not read."""
    folder, (rows, queries) = _folder(spark, "cells"), _vectors(spark, d)
    neighbours.build(rows, folder)
    return neighbours.search(spark, folder, queries, 10, exact=True).select("query_id", F.col("id").alias("vec_id"), "distance", "score", "rank")


@_query("SELECT count(*) AS n_queries, true AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def neighbours_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the search by codes finds nine tenths of the exact neighbours of all queries."""
    folder, (rows, queries) = _folder(spark, "cells"), _vectors(spark, d)
    neighbours.build(rows, folder)
    near, exact = neighbours.search(spark, folder, queries, 10).select("query_id", "id"), retrieval.nearest(rows, queries, 10).select("query_id", "id")
    hits = exact.join(near.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("n_queries"), (F.avg(F.coalesce("_hit", F.lit(0))) >= 0.9).alias("recalled"))


@_query("""WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS e FROM lineitem WHERE l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL), n AS (SELECT e, count(*) AS n FROM m GROUP BY e),
p AS (SELECT x.e AS a, y.e AS b, count(*) AS together FROM m x JOIN m y USING (c) WHERE x.e < y.e GROUP BY ALL),
s AS (SELECT a, b, together, f.n AS a_chunks, g.n AS b_chunks, together / (f.n + g.n - together) AS j, (SELECT count(DISTINCT c) FROM m) AS t FROM p JOIN n f ON f.e = a JOIN n g ON g.e = b)
SELECT a, b, together, a_chunks, b_chunks, round(j, 6) AS jaccard, round(CASE WHEN together = t THEN 1.0::DOUBLE ELSE ln(together * t / (a_chunks * b_chunks)) / ln(t / together) END, 6) AS npmi
FROM s WHERE together >= 25 AND j >= 0.02""")
def cooccurrences(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that deliver for the same orders."""
    out = cooccurrence.cooccurring(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 25, 0.02)
    return out.withColumns({"jaccard": F.round("jaccard", 6), "npmi": F.round("npmi", 6)})


@_query(OTHERS["bm25_search"])
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 from a stored index, built and read back."""
    folder = _folder(spark, "index")
    blocks.build(table(spark, d, "documents"), "doc_id", ["source", "text", "lang"], folder)
    return blocks.search(spark, folder, _benchmark(spark, d)).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@_query("""WITH n AS (SELECT doc_id + 5 AS doc_id, 'xx' AS lang FROM documents WHERE doc_id % 10 = 0), u AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL FROM n) SELECT * FROM u WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def stored_table(spark: SparkSession, d: str) -> DataFrame:
    """A stored table made, upserted, deleted from and compacted, each at its own size."""
    folder, docs = _folder(spark, "rows"), table(spark, d, "documents").select("doc_id", "lang")
    segments.write(spark, folder, docs, "doc_id")
    segments.write(spark, folder, docs.filter("doc_id % 10 = 0").select((F.col("doc_id") + 5).alias("doc_id"), F.lit("xx").alias("lang")), "doc_id")
    segments.compact(spark, folder)
    segments.erase(spark, folder, table(spark, d, "labels").filter("doc_id is not null"))
    return segments.read(spark, folder)


@_query("""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'next ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> ''] AS w FROM v), j AS (SELECT doc_id, len(w) AS dl, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t),
h AS (SELECT doc_id, dl, (SELECT count(*) FROM range(1, dl) r(i) WHERE w[i] = 'the' AND w[i + 1] = 'of')::INT AS a, len([x FOR x IN w IF starts_with(x, 'eren')]) AS b, len([x FOR x IN w IF x = 'next']) AS c, len([x FOR x IN w IF x = 'der']) AS e FROM j),
n AS (SELECT count(*) AS n, avg(dl) AS avg_dl, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc, count(*) FILTER (WHERE e > 0) AS de FROM h)
SELECT doc_id, round(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avg_dl)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avg_dl))
+ greatest(1e-6, ln((n - dc + 0.5) / (dc + 0.5))) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / avg_dl)) + greatest(1e-6, ln((n - de + 0.5) / (de + 0.5))) * e * 2.2 / (e + 1.2 * (0.25 + 0.75 * dl / avg_dl)), 6) AS score
FROM h, n WHERE (a > 0 OR b > 0 OR c > 0) AND e = 0""")
def match_index(spark: SparkSession, d: str) -> DataFrame:
    """A positional index built, updated and erased from; phrase, beginning and NOT from its postings, ranked."""
    folder, docs = _folder(spark, "positions"), table(spark, d, "documents").select("doc_id", "text")
    positions.write(spark, folder, docs, "doc_id", ["text"])
    positions.write(spark, folder, docs.filter("doc_id % 4 = 0").withColumn("text", F.concat(F.lit("next "), "text")), "doc_id", ["text"])
    positions.erase(spark, folder, docs.filter("doc_id % 7 = 0"), "doc_id")
    return positions.ranked_match(spark, folder, '("the of" OR eren* OR next) NOT der').withColumnRenamed("id", "doc_id")


@_query("""SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'new' ELSE 'old' END AS note FROM orders WHERE o_orderkey NOT IN (1, 5)
UNION ALL SELECT o_orderkey, 'pending', 'new' FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey NOT IN (1, 5)""")
def graph_queue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 3 == 0, "accepted").otherwise("pending").alias("status"), F.lit("old").alias("note"))
    return store.decided(store.queued(o, o.filter("document_id % 2 = 0").select("document_id", F.lit("new").alias("note"))), [1, 5], accept=False)


@_query("""SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS indexed FROM orders""")
def flags_repaired(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("indexed"))
    return store.repaired(o, o.filter("o_orderkey % 5 = 0"), o.filter("o_orderkey % 7 = 0"), name="o_orderkey")


@_query("""SELECT o_orderkey, o_orderkey = 7 AS applied, CASE WHEN o_orderkey = 7 THEN TIMESTAMP '2024-01-01 00:00:00' END AS at FROM orders""")
def suggestion_marked(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.lit(False).alias("applied"), F.lit(None).cast("timestamp").alias("at"))
    return store.marked(o, "o_orderkey", 7, "applied", "at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


@_query("""SELECT n_nationkey AS matter_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS chunks, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND n_nationkey <> 3) AS entities FROM nation""")
def matter_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = store.without_matter({"s": table(spark, d, "supplier").select(F.col("s_nationkey").alias("matter_id"))}, 3)["s"]
    return store.matter_stats(table(spark, d, "nation").select(F.col("n_nationkey").alias("matter_id")), chunks=table(spark, d, "customer").select(F.col("c_nationkey").alias("matter_id")), entities=s)


@_query("""SELECT s_suppkey, 'nation-' || s_nationkey || '-20240105' || CASE WHEN row_number() OVER w > 1 THEN '-' || (row_number() OVER w - 1) ELSE '' END AS matter_id FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)""")
def matter_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return store.unique_slugs(s, T.slug(F.concat(F.lit("Nation  "), "s_nationkey", F.lit("!"))), "s_suppkey", "2024-01-05").select("s_suppkey", "matter_id")


@_query("SELECT min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last, count(o_orderdate) AS n FROM orders")
def timeline_extent(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.timeline_bounds(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day")


@_query("""SELECT o_orderkey AS event_id, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END, CASE WHEN o_orderkey % 2 > 0 THEN DATE '1995-05-05' END) AS sort_day FROM orders
WHERE o_orderstatus = 'F' AND o_custkey % 10 = 1 AND coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END, CASE WHEN o_orderkey % 2 > 0 THEN DATE '1995-05-05' END) BETWEEN DATE '1993-01-01' AND DATE '1996-01-01'""")
def timeline_filtered(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("event_id"), F.when(k % 3 > 0, F.to_date("o_orderdate")).alias("day"), F.when(k % 2 > 0, F.lit("1995-05-05").cast("date")).alias("range_start"), F.col("o_orderstatus").alias("kind"), F.array(F.col("o_custkey") % 10).alias("entities"))
    return catalogs.timeline(o, "F", 1, "1993-01-01", "1996-01-01").select("event_id", "sort_day")


@_query("""SELECT p_partkey FROM part WHERE p_brand <> 'x' AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ste') ORDER BY p_name, p_partkey LIMIT 100""")
def entity_panel(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("node_id"), F.col("p_name").alias("label"), F.col("p_brand").alias("node_type"), F.create_map(F.lit("t"), "p_type").alias("metadata"))
    return catalogs.entity_panel(p, "STE").select("p_partkey")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'N' || p_partkey WHEN p_size % 2 = 0 THEN p_brand ELSE p_name || p_partkey END AS display_name FROM part""")
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", "p_partkey").alias("file_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("label"))
    return catalogs.display_names(p, p.filter("p_partkey % 3 = 0").select("file_name", F.concat(F.lit("N"), "p_partkey").alias("display_name"))).select("p_partkey", "display_name")


@_query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 30")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return store.tail(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 30)


@_query("SELECT n_name, true AS has_more FROM nation ORDER BY n_name LIMIT 10")
def listing(spark: SparkSession, d: str) -> DataFrame:
    return store.listed(table(spark, d, "nation").select("n_name"), "n_name", 10)


@_query("""SELECT 'region' AS "table", 'r_name' AS "column", 'string' AS type, (SELECT count(*) FROM region) AS rows UNION ALL SELECT 'nation', 'n_name', 'string', (SELECT count(*) FROM nation)""")
def tables_described(spark: SparkSession, d: str) -> DataFrame:
    got = store.described({n: table(spark, d, n) for n in ("region", "nation")})
    return got.filter(F.col("column").isin("r_name", "n_name")).select("table", "column", "type", "rows")


@_query("SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / 10.0::DOUBLE)), 9) AS score FROM part")
def logit_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(search.sigmoid((F.col("p_size") - 25) / 10.0), 9).alias("score"))


@_query("""WITH q AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS t, coalesce(list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 2)), []) AS a, l_orderkey % 4 = 0 AS refused, l_orderkey % 8 = 0 AS should, l_orderkey % 11 = 0 AS failed FROM lineitem GROUP BY 1),
m AS (SELECT *, len(list_intersect(a, t)) AS hit FROM q)
SELECT count(*) AS queries, round(avg(CASE WHEN failed THEN 0 ELSE hit / len(t) END), 6) AS recall, round(avg(CASE WHEN failed THEN 0 WHEN len(a) = len(t) AND hit = len(t) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN failed OR len(a) = 0 THEN 0 ELSE hit / len(a) END), 6) AS "precision",
round(avg(CASE WHEN failed THEN 0 ELSE hit / len(t) END), 6) AS citation_recall, round(avg((NOT failed AND refused = should)::INT), 6) AS refusal_accuracy, count(*) FILTER (WHERE failed) AS errors FROM m""")
def evaluation_run(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("truth"), F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey"))).alias("cited"))
    rows = rows.select(k.alias("query_id"), "truth", F.col("cited").alias("retrieved"), F.col("truth").alias("cited_truth"), "cited", (k % 4 == 0).alias("refused"), (k % 8 == 0).alias("should_refuse"), F.lit(1.0).alias("latency_ms"), F.when(k % 11 == 0, "failed").alias("error"))
    return catalogs.evaluation_totals(catalogs.evaluated(rows))


@_query("SELECT round(avg((l_linenumber % 2 = l_partkey % 2)::INT), 6) AS refusal_accuracy FROM lineitem")
def refusal_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(evaluation.refusal_accuracy(F.col("l_linenumber") % 2 == 1, F.col("l_partkey") % 2 == 1), 6).alias("refusal_accuracy"))


@_query("""SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN text[:1000] || chr(10) || chr(10) || '[... document truncated for length ...]' ELSE text END) AS text_md5, substr(sha256(doc_id || ':overview:document'), 1, 16) AS summary_id, round(n_chars * 0.25::DOUBLE / 50 / 60, 2) AS minutes FROM documents""")
def condensed_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(prompts.condensed(F.col("text"), 1000)).alias("text_md5"), prompts.summary_key(F.col("doc_id").cast("string"), F.lit("overview")).alias("summary_id"), prompts.summary_minutes(F.lit(1), F.col("n_chars") * 0.25, F.lit(50)).alias("minutes"))


@_query("SELECT DISTINCT source, lang FROM documents")
def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", "lang").distinct()


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def incremental_run(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: what the first has seen isn't counted again."""
    folder, e = _folder(spark, "runs"), table(spark, d, "events").withColumn("created", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    middle = e.agg(F.min("created")).first()[0]
    count = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"))
    store.run_since(spark, e.filter(F.col("created") <= middle), "created", folder, count, "event_type")
    first = store.current(spark, f"{folder}/made").select("event_type", F.col("n").alias("m")).collect()
    store.run_since(spark, e, "created", folder, count, "event_type")
    before = spark.createDataFrame(first, "event_type string, m long")
    return store.current(spark, f"{folder}/made").join(before, "event_type", "left").select("event_type", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))


@_query("""SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20""")
def newest_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")


@_query("""WITH d AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) SELECT doc_id, md5(documents.text[:500]) AS content_md5 FROM d JOIN documents USING (doc_id)""")
def top_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("summary_id"), F.col("n_chars").alias("created_at"), F.col("text").alias("content"))
    return prompts.top_summaries(s).select("doc_id", F.md5("content").alias("content_md5"))
