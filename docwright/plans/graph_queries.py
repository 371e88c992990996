"""Queries of the graph and answer operators over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.operators import answers, evaluation, graph, tables
from docwright.session import table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@_query("""SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12')) AND c_nationkey::VARCHAR = '7' AND c_acctbal / 10000 >= 0.2
UNION ALL SELECT c_custkey FROM customer WHERE (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')) AND c_acctbal / 10000 >= 0.9""")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"), F.col("c_nationkey").cast("string").alias("type"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return graph.find_entities(e, "12", "7", 0.2).select("c_custkey").unionAll(graph.find_entities(e, "Build", None, 0.9).select("c_custkey"))


@_query("SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n FROM lineitem WHERE l_suppkey = 5 OR l_partkey = 5 GROUP BY 1, 2")
def entity_relationships(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return graph.relationships_of(e, 5).groupBy("source", "target").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-09-30'")
def timeline_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return graph.timeline(o, "day", "1995-03-01", "1995-09-30")


@_query("""WITH k AS (SELECT unnest(['O', 'F', 'P', 'X', 'Y']) AS kind)
SELECT kind, count(o_orderkey) AS n FROM k LEFT JOIN orders ON o_orderstatus = kind GROUP BY 1""")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.kind_counts(table(spark, d, "orders"), "o_orderstatus", ["O", "F", "P", "X", "Y"])


@_query("""WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
SELECT 'entities' AS "table", count(*) AS n FROM supplier WHERE s_suppkey NOT IN (FROM gone)
UNION ALL SELECT 'links', count(*) FROM lineitem WHERE l_suppkey NOT IN (FROM gone) AND l_partkey NOT IN (FROM gone)""")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    left = graph.cascade(s.filter("s_acctbal < 0"), "s_suppkey", {"entities": (s, ("s_suppkey",)), "links": (table(spark, d, "lineitem"), ("l_suppkey", "l_partkey"))})
    counts = [rows.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, rows in left.items()]
    return counts[0].unionAll(counts[1])


@_query("""WITH m AS (SELECT DISTINCT l_orderkey AS t, s_suppkey AS e, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY t ORDER BY name, e) <= 2),
v AS (SELECT p_partkey AS ev, p_partkey % (SELECT max(s_suppkey) FROM supplier) AS e, make_date(2000 + p_size, 1, 1) AS day, p_brand AS label FROM part),
o AS (SELECT DISTINCT t, ev, day, label FROM k JOIN v USING (e)), f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY day, ev) AS n FROM o QUALIFY n <= 3)
SELECT t AS text_id, (SELECT string_agg(name, ',' ORDER BY name, e) FROM k WHERE k.t = x.t) AS entities, (SELECT string_agg(label, ',' ORDER BY n) FROM f WHERE f.t = x.t) AS events FROM (SELECT DISTINCT t FROM k) x""")
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    m = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("text_id"), F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    one = s.agg(F.max("s_suppkey").alias("top"))
    v = table(spark, d, "part").join(F.broadcast(one)).select(F.col("p_partkey").alias("event_id"), (F.col("p_partkey") % F.col("top")).alias("entity_id"), F.make_date(F.col("p_size") + 2000, F.lit(1), F.lit(1)).alias("day"), F.col("p_brand").alias("label"))
    out = graph.context(m, v, 2, 3)
    return out.select("text_id", F.array_join("entities", ",").alias("entities"), F.array_join("events", ",").alias("events"))


@_query("""WITH t AS (SELECT o_custkey AS query_id, o_orderkey AS p, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS term FROM orders),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY p) = 1) SELECT query_id, string_agg(term, '|' ORDER BY p) AS terms FROM f GROUP BY 1""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("position"), spelled.alias("term"))
    return graph.expanded(t).select("query_id", F.array_join("terms", "|").alias("terms"))


@_query("""WITH t AS (SELECT l_orderkey AS id, strftime(make_date(2000 + l_linenumber, 3, 1 + (l_partkey % 3)::INT), '%Y-%m-%d') AS day, l_linenumber FROM lineitem),
o AS (SELECT id % 50 AS id, day FROM t) SELECT id, day, count(*) AS mentions FROM o GROUP BY 1, 2 HAVING count(*) >= 3""")
def date_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Dates in three spellings, gathered to texts by order."""
    day = F.make_date(F.col("l_linenumber") + 2000, F.lit(3), (F.col("l_partkey") % 3 + 1).cast("int"))
    said = F.when(F.col("l_linenumber") % 3 == 0, F.date_format(day, "d MMMM yyyy")).when(F.col("l_linenumber") % 3 == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    texts = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("id")).agg(F.array_join(F.collect_list(F.concat(F.lit("on "), said)), ". ").alias("text"))
    return graph.date_events(texts, "id", "text")


@_query(f"""SELECT doc_id, regexp_matches(lower(text), '{"|".join(graph.EVENT_WORDS)}') AS is_event, CASE
{" ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{k}'" for k, w in graph.EVENT_KINDS)} ELSE 'other' END AS kind FROM documents""")
def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", graph.is_event(F.col("text")).alias("is_event"), graph.event_kind(F.col("text")).alias("kind"))


@_query()
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Supplier names, some with a letter changed, resolved by nation; tested against brute force."""
    s = table(spark, d, "supplier")
    asked = s.select(F.col("s_nationkey").cast("string").alias("type"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("x"))).otherwise(F.upper("s_name")).alias("name"))
    known = s.select(F.col("s_nationkey").cast("string").alias("type"), F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return graph.resolved(asked, known)


@_query("""SELECT conv_id, turn, CASE WHEN text IS NULL OR length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 3 THEN 'block'
WHEN regexp_matches(lower(text), 'ignore previous instructions|act as a|you are now') THEN 'warning' ELSE 'info' END AS level FROM conversations""")
def input_guards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", answers.input_guard(F.col("text")).alias("level"))


@_query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_linenumber <= 4 AND l_returnflag = 'N') / count(*) < 0.5 THEN 'warning' ELSE 'info' END AS level FROM lineitem GROUP BY 1""")
def output_guards(spark: SparkSession, d: str) -> DataFrame:
    good = F.count_if((F.col("l_linenumber") <= 4) & (F.col("l_returnflag") == "N"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(answers.output_guard(good, F.count("*")).alias("level"))


@_query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type || chr(10) || p_brand ELSE p_name END AS answer FROM part")
def channels(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda name, body: F.concat(F.lit(f"<|channel|>{name}<|message|>"), F.col(body))
    final = F.concat(tag("analysis", "p_type"), F.lit("<|end|>"), tag("final", "p_brand"), F.lit("<|end|>"))
    both = F.concat(tag("analysis", "p_type"), F.lit("<|end|>"), tag("commentary", "p_brand"))
    said = F.when(F.col("p_size") % 3 == 0, final).when(F.col("p_size") % 3 == 1, both).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\n")))
    return table(spark, d, "part").select("p_partkey", answers.final_channel(said).alias("answer"))


@_query("SELECT p_partkey, p_brand AS brand, p_size AS size FROM part")
def fenced_objects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    body = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    said = p.select("p_partkey", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")).alias("t"))
    return said.select("p_partkey", answers.fenced_json(F.col("t"), "brand string, size int").alias("o")).select("p_partkey", "o.brand", "o.size")


@_query(r"""WITH c AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s"*-]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM benchmark)
SELECT item_id, CASE WHEN q = '' THEN '""' WHEN regexp_matches(q, '["*]') OR NOT contains(q, ' ') THEN q ELSE replace(q, ' ', ' OR ') END AS q FROM c""")
def keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", answers.search_words(F.col("text")).alias("q"))


@_query("""WITH e AS (SELECT event_id, epoch(max(ts) OVER ())::BIGINT - epoch(ts)::BIGINT AS s, ts FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))
SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
WHEN s < 172800 THEN 'Yesterday' WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE strftime(ts, '%d %b') END AS age FROM e""")
def chat_ages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", answers.age(F.col("ts"), F.col("now")).alias("age"))  # one row


@_query(r"""WITH l AS (SELECT doc_id, source, string_split(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10))[1] AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) BETWEEN 8 AND 80 THEN x ELSE source END AS label FROM l""")
def label_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", answers.suggested_label(F.lit(None).cast("string"), F.col("text"), F.col("source")).alias("label"))


@_query("""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS source_id, replace(text, chr(10), ' ') AS t FROM conversations)
SELECT conv_id, turn, source_id, md5(CASE WHEN length(t) > 200 THEN t[:200] || '…' ELSE t END) AS preview_md5 FROM s""")
def numbered_sources(spark: SparkSession, d: str) -> DataFrame:
    return answers.source_map(table(spark, d, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", "source_id", F.md5("preview").alias("preview_md5"))


@_query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber, l_returnflag, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag <> 'N') - 1)::INT AS number FROM lineitem)
SELECT id AS l_orderkey, number, 'Line ' || l_linenumber || ' of this order came back late.' AS sentence FROM s WHERE l_returnflag <> 'N'""")
def uncited(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each line; those with flag N carry a citation."""
    cite = F.when(F.col("l_returnflag") == "N", F.lit(" [Source: part | Page 1]")).otherwise(F.lit(""))
    said = F.concat(F.lit("Line "), F.col("l_linenumber"), F.lit(" of this order came back late"), cite, F.lit(". "))
    texts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", said.alias("s")))), lambda x: x["s"]), "").alias("text"))
    return answers.uncited_sentences(texts, "l_orderkey", "text").withColumnRenamed("id", "l_orderkey")


@_query("""WITH l AS (SELECT event_type AS file, event_id AS number, CASE WHEN value > 100 THEN 'ERROR ' ELSE 'ok ' END || event_id AS t FROM events),
c AS (SELECT *, concat_ws(chr(10), t, lead(t, 1) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w) AS context FROM l WINDOW w AS (PARTITION BY file ORDER BY number))
SELECT file, number, context FROM c WHERE contains(t, 'ERROR') QUALIFY row_number() OVER (PARTITION BY file ORDER BY number DESC) <= 10""")
def log_errors(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("value") > 100, "ERROR ").otherwise("ok "), F.col("event_id"))
    return answers.log_errors(table(spark, d, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("number"), line.alias("t")), "file", "number", "t")


@_query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS latest, max(ts) AS at FROM events GROUP BY 1")
def latest_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("at"))


@_query("""SELECT count(*) AS total, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS indexed, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending,
count(*) FILTER (WHERE text IS NULL OR text = '') AS errored, round(100.0::DOUBLE * count(l.doc_id) / count(*), 6) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def catalog_kpi(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("indexed", F.lit(True))
    return tables.catalog_kpi(table(spark, d, "documents").join(known, "doc_id", "left").withColumn("errored", F.col("text").isNull() | (F.col("text") == "")), "indexed", "errored")


@_query("""WITH q AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS t, coalesce(list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 2 OR l_returnflag = 'R')), []) AS a FROM lineitem GROUP BY 1),
m AS (SELECT *, len(list_intersect(a, t)) AS hit FROM q)
SELECT count(*) AS queries, round(avg((len(a) = len(t) AND hit = len(t))::INT), 6) AS accuracy, round(avg(CASE WHEN len(a) > 0 THEN hit / len(a) ELSE 0 END), 6) AS "precision", round(avg(hit / len(t)), 6) AS recall FROM m""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when((F.col("l_linenumber") <= 2) | (F.col("l_returnflag") == "R"), F.col("l_partkey"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("truth"), F.collect_set(shown).alias("actual"))
    scores = evaluation.citation_scores(F.col("actual"), F.col("truth"))
    return rows.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(n) for n, c in scores.items()])


@_query("""WITH n AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 = 0)
SELECT d.doc_id, CASE WHEN n.doc_id IS NOT NULL THEN 'xx' ELSE d.lang END AS lang, d.n_chars FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""")
def catalog_update(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = docs.filter("doc_id % 7 = 0").select("doc_id", F.lit("xx").alias("lang"), F.lit(None).cast("long").alias("n_chars"))
    return tables.update_fields(docs, new, "doc_id")


@_query("""SELECT o_orderkey AS parent, 'general' AS kind, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'config', 'status=' || o_orderstatus FROM orders""")
def child_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority").alias("suggestions"), F.create_map(F.lit("status"), "o_orderstatus").alias("changes"))
    return tables.children(o, "o_orderkey", "suggestions", "changes")


@_query("""WITH d AS (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 1 ELSE 0 END AS empty FROM conversations WHERE turn <= 2)
SELECT conv_id, avg(CASE WHEN turn = 0 OR empty = 1 THEN 1 ELSE 0 END) >= 0.8 AS scanned FROM d GROUP BY 1""")
def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), F.when(F.col("turn") == 0, "").otherwise(F.col("text")).alias("text"))
    return tables.scanned(pages, "conv_id", "page", "text")
