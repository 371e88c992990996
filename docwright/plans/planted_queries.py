"""Queries of classification, metadata, parties, events and graph updates over texts made of table rows and planted phrases, each beside SQL that computes its rows from the tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.operators import catalogs, classifier, made_graph, parties, prompts
from docwright.plans.more_queries import _folder
from docwright.plans.oracle import kinds_sql
from docwright.session import table

QUERIES, SQL = {}, {}


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _values(rows: list[tuple], columns: str) -> str:
    """Literal rows as a SQL table."""
    said = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({columns})"


#: Texts that speak as the documents the rules are made for.
SAMPLES = [
    (1, "WITNESS STATEMENT of Jane Roe\nMy name is Jane. I make this statement in support. Statement of truth: I believe that the facts are true.", "x/ws-1.pdf"),
    (2, "IN THE HIGH COURT\nClaim No: CL-2024-000123\nBetween:\nAcme Limited\nClaimant\nPARTICULARS OF CLAIM\n1. The breach of contract.\n", "x/poc_a.docx"),
    (3, "From: a@b.org\nTo: c@d.org\nSubject: Delivery\nDate: 12 March 2024\nDear Sir, yours faithfully", "x/mail.eml"),
    (4, "This agreement is made. Whereas the parties agree. In witness whereof executed as a deed. Schedule 1", "x/contract_1.pdf"),
    (5, "[2023] EWHC 123 (Comm) approved judgment Lord Justice Smith", "x/case.pdf"),
    (6, "Schedule of loss. Quantum of damages. Loss of profit $1,000.00 total claimed", "x/y.pdf"),
    (7, "Agreed chronology of facts and issues 01/02/2024: meeting", "chronology-1"),
    (8, "nothing of note", None), (9, None, "x/report-expert.pdf"),
    (10, "Statement of: John Smith Brown\nWitness: Al Bo. I, Mary Ann Jones, say as follows. Case No: AB-12 on 3/4/2021 and 05.06.2022, 7 May 2020; June 8, 2019", "w/a.txt"),
    (11, "Smith Trading v. Jones plc\nfiled 1 March 2024 under [2022] EWHC 77 (Ch), claim QB21A12345", "w/b.txt"),
    (12, "Between: Red Fox Ltd Claimant and Blue Hen LLP Defendant", "w/c.txt"),
]
_SAMPLES = _values(SAMPLES, "id, text, path")


#: Each customer's text: the phrase of its turn and what the row says.
_SPOKEN = f"""(SELECT c_custkey AS id, v.text || chr(10) || c_name || ' of ' || c_mktsegment AS text, v.path || '.' || c_nationkey AS path FROM customer JOIN {_SAMPLES} ON c_custkey % {len(SAMPLES)} + 1 = v.id)"""


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    phrases = spark.createDataFrame(SAMPLES, "_n int, text string, path string")
    met = table(spark, d, "customer").join(F.broadcast(phrases), F.col("c_custkey") % len(SAMPLES) + 1 == F.col("_n"))  # a row a phrase
    text = F.concat("text", F.lit("\n"), "c_name", F.lit(" of "), "c_mktsegment")
    return met.select(F.col("c_custkey").alias("id"), text.alias("text"), F.concat("path", F.lit("."), "c_nationkey").alias("path"))


@_query(kinds_sql(f"SELECT id, text, path FROM {_SPOKEN}", "id"))
def sample_kinds(spark: SparkSession, d: str) -> DataFrame:
    out = classifier.classified(_spoken(spark, d), "id", "text", F.col("path"))
    return out.select("id", "kind", "score", F.round("confidence", 6).alias("confidence"))


def _quoted(p: str) -> str:
    return p.replace("'", "''")


_DATES = "list_concat(" + ", ".join(f"regexp_extract_all(o, '(?i){_quoted(p)}', 1)[:5]" for p in parties.DATES) + ")"
_CASE = f"WHEN regexp_matches(o, '(?i){parties.CASES[0]}') THEN '[' || regexp_extract(o, '(?i){parties.CASES[0]}', 1) || '] EWHC ' || regexp_extract(o, '(?i){parties.CASES[0]}', 2) " + " ".join(
    f"WHEN regexp_matches(o, '(?i){p}') THEN regexp_extract(o, '(?i){p}', 1)" for p in parties.CASES[1:])
_AUTHOR = " ".join(f"WHEN regexp_matches(o, '{p}') THEN trim(regexp_extract(o, '{p}', 1))" for p in parties.AUTHORS)
_BETWEEN, _VERSUS = parties.PARTIES


@_query(f"""WITH s AS (SELECT id, coalesce(text, '')[:5000] AS o FROM {_SPOKEN}), x AS (SELECT *, {_DATES} AS ds FROM s)
SELECT id, ds[1] AS document_date, CASE WHEN len(ds) > 1 THEN array_to_string(ds[:5], ', ') END AS dates_mentioned, CASE {_CASE} END AS case_number,
CASE WHEN regexp_matches(o, '(?i){_BETWEEN}') THEN trim(regexp_extract(o, '(?i){_BETWEEN}', 1)) WHEN regexp_matches(o, '(?i){_VERSUS}')
THEN trim(regexp_extract(o, '(?i){_VERSUS}', 1)) || ' v ' || trim(regexp_extract(o, '(?i){_VERSUS}', 2)) END AS parties, CASE {_AUTHOR} END AS author FROM x""")
def sample_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _spoken(spark, d).select("id", *[c.alias(n) for n, c in parties.metadata(F.col("text")).items()])


#: A supplier's text: its region's firm so often, as a claimant in every other one, a small firm, a day, and names that no party has.
_FIRMS = """(SELECT s_suppkey AS id, s_name AS name, ['pleading', 'email', 'expert_report'][s_suppkey % 3 + 1] AS kind, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(r_name, ' ')], ' ') AS region,
s_suppkey % 5 AS n, s_suppkey % 2 AS role, s_suppkey % 4 AS m, s_suppkey % 6 AS days, 1990 + s_suppkey % 30 AS year FROM supplier JOIN region ON s_nationkey % 5 = r_regionkey)"""
#: What the text holds, counted from the row: a mention weighs 2, one with a role 3 more.
_NAMED = f"""(SELECT id, kind AS doc_kind, region || ' Trading Limited' AS name, lower(region) || ' trading limited' AS normalized, 2 * (n + role) + 3 * role AS score FROM {_FIRMS}
UNION ALL SELECT id, kind, string_split(region, ' ')[-1] || ' & Co', lower(string_split(region, ' ')[-1]) || ' co', 2 * m FROM {_FIRMS})"""


def _firms(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "region")), F.col("s_nationkey") % 5 == F.col("r_regionkey"))  # five regions
    k, region = F.col("s_suppkey"), F.initcap("r_name")
    firm, small = F.concat(region, F.lit(" Trading Limited")), F.concat(F.element_at(F.split(region, " "), -1), F.lit(" & Co"))
    many = lambda text, n: F.repeat(text, n.cast("int"))
    text = F.concat(
        many(F.concat(F.lit("- we paid; "), firm, F.lit(". ")), k % 5), many(F.concat(F.lit("so; "), firm, F.lit(" (the 'Claimant') sued. ")), k % 2),
        many(F.concat(F.lit("it wrote; "), small, F.lit(" did. ")), k % 4), many(F.concat(F.lit("on 5 March "), (1990 + k % 30).cast("string"), F.lit(" it was. ")), k % 6),
        many(F.lit("sat; Justice Fox Limited. met; London Holdings Limited. "), F.lit(4)))
    kind = F.element_at(F.array(*map(F.lit, ("pleading", "email", "expert_report"))), (k % 3 + 1).cast("int"))
    return s.select(k.alias("id"), F.col("s_name").alias("name"), kind.alias("kind"), text.alias("text"))


@_query(f"SELECT id, name, 'company' AS kind, score::BIGINT AS score, round(least(score / 5.0, 1.0), 6)::DOUBLE AS confidence FROM {_NAMED} WHERE score >= 6")
def party_candidates(spark: SparkSession, d: str) -> DataFrame:
    return parties.parties(_firms(spark, d), "id", "text").select("id", "name", "kind", "score", F.round("confidence", 6).alias("confidence"))


_KEY = "'{0}_' || substr(sha256(id || '|' || {1}), 1, 12)"


@_query(f"""WITH p AS (SELECT * FROM {_NAMED} WHERE score >= 6 AND doc_kind <> 'email'), e AS (SELECT *, year || '-03-05' AS day FROM {_FIRMS} WHERE days >= 3 AND kind <> 'email')
SELECT id::VARCHAR AS document_id, 'document' AS part, id::VARCHAR AS a, NULL AS b, name AS label FROM {_FIRMS}
UNION ALL SELECT id::VARCHAR, 'party', {_KEY.format('party', 'normalized')}, NULL, name FROM p
UNION ALL SELECT id::VARCHAR, 'event', {_KEY.format('event', 'day')}, NULL, '05 March ' || year FROM e
UNION ALL SELECT id::VARCHAR, 'mentioned_in', {_KEY.format('party', 'normalized')}, id::VARCHAR, NULL FROM p
UNION ALL SELECT id::VARCHAR, 'references_date', id::VARCHAR, {_KEY.format('event', 'day')}, NULL FROM e""")
def graph_updates(spark: SparkSession, d: str) -> DataFrame:
    """Every node and edge, with ids and labels."""
    nodes, edges = parties.graph_update(_firms(spark, d), "id", "name", F.col("kind"), "text")
    none = F.lit(None).cast("string")
    out = nodes.select("document_id", F.col("node_type").alias("part"), F.col("node_id").alias("a"), none.alias("b"), "label")
    return out.unionByName(edges.select("document_id", F.col("relation").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), none.alias("label")))


@_query("""SELECT o_orderkey AS id, o_orderdate::DATE AS day, ['meeting', 'filing'][o_orderkey % 4 + 1] AS kind, 'Order ' || o_orderkey || ' of old' AS description FROM orders WHERE o_orderkey % 4 < 2
UNION ALL SELECT o_orderkey, o_orderdate::DATE + 1, 'filing', 'later they filed it' FROM orders WHERE o_orderkey % 3 = 0""")
def chunk_events(spark: SparkSession, d: str) -> DataFrame:
    """Days in words, met or filed on, among days of birth and days that no calendar has; a second one beyond the first's surroundings."""
    k, said = F.col("o_orderkey"), lambda day: F.date_format(day, "d MMMM yyyy")
    day = F.to_date("o_orderdate")
    first = F.concat(F.lit("Order "), k.cast("string"), F.lit(" of old. "),
                     F.when(k % 4 == 0, F.concat(F.lit("We met on "), said(day))).when(k % 4 == 1, F.concat(F.lit("We filed it on "), said(day))).when(k % 4 == 2, F.concat(F.lit("Born on "), said(day)))
                     .otherwise(F.lit("We met on 31 February 1999")), F.lit(". "))
    second = F.when(k % 3 == 0, F.concat(F.repeat(F.lit("x"), 200), F.lit(". later they filed it. On "), said(F.date_add(day, 1)), F.lit(" so."))).otherwise("")
    rows = table(spark, d, "orders").select(k.alias("id"), F.concat(first, second).alias("text"))
    found = parties.chunk_events(rows, "id", "text").select("id", "day", "kind", "description")
    # A context that begins in the long word has it as its first sentence.
    return found.withColumn("description", F.when(F.startswith("description", F.lit("xxx")), "later they filed it").otherwise(F.col("description")))


@_query("""WITH k AS (SELECT doc_id, n_chars, ['witness_statement', 'skeleton_argument', 'expert_report', 'schedule_of_loss', 'contract', 'statute', 'letter', 'chronology'][doc_id % 8 + 1] AS kind FROM documents),
s AS (SELECT *, CASE WHEN kind IN ('witness_statement', 'expert_report') THEN 4096 WHEN kind IN ('schedule_of_loss', 'contract') THEN 3072 ELSE 2048 END AS size FROM k)
SELECT doc_id, kind, size, size // 2 AS overlap, CASE WHEN kind IN ('witness_statement', 'contract', 'statute') THEN kind ELSE 'disclosure' END AS category,
kind IN ('witness_statement', 'skeleton_argument', 'expert_report') AS in_graph, ceil(n_chars / (size // 2))::BIGINT AS windows FROM s""")
def chunk_settings(spark: SparkSession, d: str) -> DataFrame:
    """Each document's sizes by its kind, and the windows it is cut into."""
    names = ("witness_statement", "skeleton_argument", "expert_report", "schedule_of_loss", "contract", "statute", "letter", "chronology")
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 8 + 1).cast("int"))
    size, overlap = prompts.chunk_size(F.col("kind"))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", kind.alias("kind")).withColumns({"size": size, "overlap": overlap})
    return rows.select("doc_id", "kind", "size", "overlap", catalogs.category(F.col("kind")).alias("category"), catalogs.in_graph(F.col("kind")).alias("in_graph"), F.ceil(F.col("n_chars") / (F.col("size") - F.col("overlap"))).alias("windows"))


@_query(f"""WITH f AS (SELECT * FROM {_FIRMS} WHERE id % 3 <> 1), g AS (SELECT * FROM f WHERE id % 11 <> 0)
SELECT 'extracted' AS what, count(*) AS n FROM g UNION ALL SELECT 'failed', count(*) FROM f WHERE id % 11 = 0 HAVING count(*) > 0 UNION ALL SELECT 'document', count(*) FROM g
UNION ALL SELECT 'party', count(*) FROM {_NAMED} JOIN g USING (id) WHERE score >= 6 AND doc_kind <> 'email' HAVING count(*) > 0 UNION ALL SELECT 'event', count(*) FROM g WHERE days >= 3 AND kind <> 'email' HAVING count(*) > 0""")
def graph_reextracted(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the records that are to be in it, extracted anew; some have no text."""
    k = F.col("id")
    records = _firms(spark, d).select(k.alias("document_id"), "name", "kind", F.when(k % 11 != 0, F.col("text")).alias("text"), (k % 3 != 1).alias("include_in_graph"))
    return made_graph.reextract(spark, _folder(spark, "reextracted"), records)


def _answers(asked: list[str]) -> list[str]:
    """What a model would say to the prompts of `made_graphs`; to some nothing of use."""
    said = []
    for prompt in asked:
        number, name, place, day = re.search(r"Summary:\n(\d+): (\S+) of (.*) met on (\S+)$", prompt).groups()
        if int(number) % 7 == 0:
            said.append("I can't tell.")
        elif prompt.startswith("List the entities"):
            said.append("```json\n" + json.dumps([{"type": "organization", "name": name, "aliases": [f"Firm {number}"], "confidence": 0.9}, {"type": "location", "name": place}, {"type": "ghost", "name": "x"}, {"type": "person"}]) + "\n```")
        elif prompt.startswith("List the relations"):
            said.append(json.dumps([{"source": f"firm {number}", "target": place.lower(), "type": "related_to"}, {"source": name, "target": "nobody", "type": "signed"}, {"source": name, "target": place, "type": "likes"}]))
        else:
            said.append(json.dumps([{"date": day, "description": "met", "event_type": "meeting", "entities": [name]}, {"date": "soon", "date_text": "soon"}, {"date": day, "event_type": "party"}]))
    return said


@_query("""WITH s AS (SELECT s_suppkey AS k, s_name AS name, n_name AS place, (DATE '2020-01-01' + (s_suppkey % 300)::INT)::VARCHAR AS day FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0)
SELECT 'entity' AS part, name AS document, 'organization' AS a, name AS b, 0.9::DOUBLE AS confidence FROM s UNION ALL SELECT 'entity', name, 'location', place, 0.8 FROM s
UNION ALL SELECT 'relation', name, name, place, 0.8 FROM s UNION ALL SELECT 'event', name, 'meeting', day, NULL FROM s UNION ALL SELECT 'event', name, 'other', NULL, NULL FROM s""")
def made_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Entities, relations with the entities that they resolve to, and events, from answers about each supplier."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")).cast("string")
    content = F.concat(F.col("s_suppkey").cast("string"), F.lit(": "), "s_name", F.lit(" of "), "n_name", F.lit(" met on "), day)
    summaries = s.select(F.col("s_name").alias("name"), content.alias("content"))
    found = made_graph.entities_of(summaries, _answers)
    known = made_graph.numbered(found)
    relations = made_graph.relations_of(summaries, known, _answers)
    for end in ("source", "target"):
        relations = relations.join(known.select(F.col("entity_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id")
    out = found.select(F.lit("entity").alias("part"), "document", F.col("type").alias("a"), F.col("name").alias("b"), "confidence")
    out = out.unionByName(relations.select(F.lit("relation").alias("part"), "document", F.col("source_name").alias("a"), F.col("target_name").alias("b"), "confidence"))
    events = made_graph.events_of(summaries, _answers)
    return out.unionByName(events.select(F.lit("event").alias("part"), "document", F.col("kind").alias("a"), F.col("day").cast("string").alias("b"), F.lit(None).cast("double").alias("confidence")))
