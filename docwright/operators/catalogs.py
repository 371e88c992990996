"""Catalog, panel and timeline views, scanned tokens, and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docwright.operators import evaluation

#: Categories a catalog keeps, and kinds that go to the graph.
CATEGORIES = ("witness_statement", "court_filing", "pleading", "statute", "contract", "disclosure", "email", "tribunal", "medical")
GRAPH_KINDS = ("witness_statement", "pleading", "court_filing", "skeleton_argument", "expert_report")


def category(kind: Column) -> Column:
    return F.when(kind.isin(*CATEGORIES), kind).otherwise("disclosure")


def in_graph(kind: Column) -> Column:
    return F.coalesce(kind.isin(*GRAPH_KINDS), F.lit(False))


def display_names(catalog: DataFrame, names: DataFrame, key: str = "file_name") -> DataFrame:
    """catalog with display_name: the given one, else the label, else the file's name."""
    return catalog.join(names.select(key, F.col("display_name").alias("_given")), key, "left").withColumn("display_name", F.coalesce(F.nullif("_given", F.lit("")), F.nullif("label", F.lit("")), key)).drop("_given")


def entity_panel(nodes: DataFrame, part: str = "", kind: str | None = None, most: int = 100) -> DataFrame:
    """The first nodes by label of a type whose label, type or metadata values hold `part`, in any case."""
    held = F.contains(F.lower(F.concat_ws(" ", "label", "node_type", F.map_values("metadata"))), F.lit(part.lower()))
    found = nodes.filter(held) if kind is None else nodes.filter(held & (F.col("node_type") == kind))
    return found.orderBy("label", "node_id").limit(most)


def timeline(events: DataFrame, kind: str | None = None, entity=None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events (event_id, day, range_start, kind, entities) with sort_day, in its order, undated ones last; of one kind, of one entity, and in an inclusive range as asked."""
    out = events.withColumn("sort_day", F.coalesce("day", "range_start"))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if entity is not None:
        out = out.filter(F.array_contains("entities", entity))
    if first is not None:
        out = out.filter(F.col("sort_day") >= F.lit(first).cast("date"))
    if last is not None:
        out = out.filter(F.col("sort_day") <= F.lit(last).cast("date"))
    return out.orderBy(F.asc_nulls_last("sort_day"), "event_id")


def timeline_bounds(events: DataFrame, day: str) -> DataFrame:
    return events.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(day).alias("n"))


def summary_stats(summaries: DataFrame) -> DataFrame:
    """(part, value, n, documents): totals, and counts by type and by level, in one pass."""
    sets = summaries.groupingSets([["summary_type"], ["summary_level"], []], "summary_type", "summary_level")
    out = sets.agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "level").otherwise("all").alias("part"), F.coalesce("summary_type", "summary_level").alias("value"), "n", "documents")


def ocr_lines(tokens: DataFrame, group: str, order: str, confidence: int = 60) -> DataFrame:
    """(group, line, text, low): text lines of recognised words (text, conf, top, height); words under the confidence are left out and counted.

    A word starts a line when it stands lower than the one before by over half of that one's height.
    """
    by = W.partitionBy(group).orderBy(order)
    low = F.col("conf") < confidence
    good = tokens.filter(~low & (F.trim("text") != ""))
    breaks = F.when(F.col("top") > F.lag("top").over(by) + 0.5 * F.lag("height").over(by), 1).otherwise(0)
    rows = good.withColumn("_b", breaks).withColumn("line", F.sum("_b").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    words = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    bad = tokens.groupBy(group).agg(F.count_if(low).alias("low"))
    return rows.groupBy(group, "line").agg(F.array_join(words, " ").alias("text")).join(bad, group)


def evaluated(results: DataFrame, k: int = 10) -> DataFrame:
    """A row for each query of results (query_id, truth, retrieved, cited_truth, cited, refused, should_refuse, latency_ms, error); a failed query has its error and scores of 0."""
    scores = evaluation.citation_scores(F.col("cited"), F.col("cited_truth"))
    ok = F.col("error").isNull()
    zero = lambda c: F.when(ok, c).otherwise(0.0)
    return results.select("query_id", zero(evaluation.recall_at(F.col("retrieved"), F.col("truth"), k)).alias("recall"), *[zero(c).alias({"recall": "citation_recall"}.get(n, n)) for n, c in scores.items()],
                          (ok & F.col("refused").eqNullSafe(F.col("should_refuse"))).alias("refusal_right"), "latency_ms", "error",
                          (F.size("cited") + F.size("cited_truth") > 0).alias("has_citations"))


def evaluation_totals(rows: DataFrame) -> DataFrame:
    """Means over evaluated queries; citation scores count where either side has citations."""
    cited = lambda c: F.round(F.avg(F.when(F.col("has_citations"), F.col(c))), 6).alias(c)
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), cited("accuracy"), cited("precision"), cited("citation_recall"),
                    F.round(F.avg(F.col("refusal_right").cast("int")), 6).alias("refusal_accuracy"), F.count("error").alias("errors"))
