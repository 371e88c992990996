"""A graph made by a generator from summaries: entities, relations between them and dated events; and the job that extracts a catalog's graph anew.

Summaries (name, content). A generator answers prompts in batches inside tasks (`jobs.generated`); its answers are
written once, so that no later step asks again. An answer that is no array, also after a fence is taken off, gives nothing; of an array, items
without what they need or of an unknown kind are left out, the others stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docwright.jobs import Generator, generated, parsed
from docwright.operators.parties import graph_update, related
from docwright.operators.store import current, publish, reset
from docwright.session import saved

#: The kinds of entities, relations and events.
ENTITY_KINDS = ("person", "organization", "date", "amount", "location", "case_ref", "document_ref", "event", "email_address", "phone")
RELATION_KINDS = (
    "sent_to", "copied_on", "replied_to", "employed_by", "director_of", "represents", "party_to", "witness_for", "expert_for",
    "attended", "signed", "authored", "mentioned_with", "related_to",
)
EVENT_KINDS = ("meeting", "communication", "transaction", "filing", "hearing", "deadline", "contract", "incident", "other")
#: Confidence where the answer gives none; how many known names a prompt of relations lists.
CONFIDENCE, NAMES = 0.8, 50


def _request(wanted: str, fields: str, about: str = "") -> Column:
    head = F.lit(f"List the {wanted} of this summary as a JSON array of objects with {fields}.\n{about}Document: ")
    return F.concat(head, F.coalesce("name", F.lit("")), F.lit("\nSummary:\n"), F.coalesce("content", F.lit("")))


def _items(summaries: DataFrame, prompt: Column, generator: Generator, schema: str, name: str) -> DataFrame:
    """(document, item): an item of each answer a row."""
    asked = summaries.select(F.col("name").alias("document"), prompt.alias("prompt"))
    answers = saved(generated(asked, "prompt", generator), name).select("document", "answer")
    return parsed(answers, "answer", f"array<struct<{schema}>>").select("document", F.explode("parsed").alias("item"))


def entities_of(summaries: DataFrame, generator: Generator) -> DataFrame:
    """(document, type, name, aliases, confidence) of each summary; one that is in two summaries has a row for each."""
    fields = f"type (one of {', '.join(ENTITY_KINDS)}), name, aliases and confidence (0 to 1)"
    rows = _items(summaries, _request("entities", fields), generator, "type string, name string, aliases array<string>, confidence double", "made-entities").select("document", "item.*")
    rows = rows.filter(F.col("type").isin(*ENTITY_KINDS) & F.col("name").isNotNull())
    return rows.select("document", "type", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))


def relations_of(summaries: DataFrame, entities: DataFrame, generator: Generator) -> DataFrame:
    """(document, type, source, target, source_id, target_id, confidence) between known entities (entity_id, name, aliases); the prompt lists the first of them by id.

    Ends are met by name or alias in any case; a relation with an unknown end goes.
    """
    known = ", ".join(r["name"] for r in entities.filter("name IS NOT NULL").orderBy("entity_id").select("name").limit(NAMES).collect())
    fields = f"source and target (names of known entities), type (one of {', '.join(RELATION_KINDS)}) and confidence (0 to 1)"
    rows = _items(summaries, _request("relations", fields, f"Known entities: {known}\n"), generator, "source string, target string, type string, confidence double", "made-relations").select("document", "item.*")
    rows = rows.filter(F.col("type").isin(*RELATION_KINDS)).withColumn("confidence", F.coalesce("confidence", F.lit(CONFIDENCE)))
    return related(rows, entities).select("document", "type", "source", "target", "source_id", "target_id", "confidence")


def events_of(summaries: DataFrame, generator: Generator) -> DataFrame:
    """(document, day, date_text, description, kind, entities): the day is null where the answer's is no ISO date; without a kind it is `other`."""
    fields = f"date (YYYY-MM-DD or null), date_text, description, event_type (one of {', '.join(EVENT_KINDS)}) and entities"
    schema = "date string, date_text string, description string, event_type string, entities array<string>"
    rows = _items(summaries, _request("dated events", fields), generator, schema, "made-events").filter("item IS NOT NULL").select("document", "item.*")
    kind = F.coalesce("event_type", F.lit("other"))
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.filter(kind.isin(*EVENT_KINDS)).select("document", day.alias("day"), text("date_text"), text("description"), kind.alias("kind"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def numbered(entities: DataFrame) -> DataFrame:
    """(entity_id, type, name, aliases, confidence, documents): rows of one type and name made one, with an id that follows from both."""
    made = entities.groupBy("type", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"), F.max("confidence").alias("confidence"), F.count_distinct("document").alias("documents"))
    return made.withColumn("entity_id", F.xxhash64("type", "name")).select("entity_id", "type", "name", "aliases", "confidence", "documents")


def reextract(spark: SparkSession, folder: str, records: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """Drop the folder's pending updates and accepted graph, extract the graph of records anew and queue it for review; returns (what, n): documents extracted and failed, and nodes by type.

    Records (document_id, name, kind, text, include_in_graph): only those to be included count; one without a text, for a file that is gone or can't be read,
    has failed. The tables `nodes`, `edges` and `queue` (document_id, document_name, status) are published, `accepted` is gone.
    """
    extract = extract or (lambda rows: graph_update(rows, "document_id", "name", F.col("kind"), "text"))
    taken = saved(records.filter(F.coalesce("include_in_graph", F.lit(False))), "records")
    good = taken.filter("text IS NOT NULL")
    for name in ("accepted", "queue", "nodes", "edges"):
        reset(spark, f"{folder}/{name}")
    nodes, edges = extract(good)
    publish(nodes, f"{folder}/nodes")
    publish(edges, f"{folder}/edges")
    publish(good.select(F.col("document_id").cast("string").alias("document_id"), F.col("name").alias("document_name"), F.lit("pending").alias("status")), f"{folder}/queue")
    state = F.when(F.col("text").isNull(), "failed").otherwise("extracted").alias("what")
    kinds = current(spark, f"{folder}/nodes").groupBy(F.col("node_type").alias("what")).agg(F.count("*").alias("n"))
    return taken.groupBy(state).agg(F.count("*").alias("n")).unionByName(kinds)
