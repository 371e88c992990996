"""Pattern extraction of entities, timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window as W

#: Fixed values: (kind, pattern, confidence).
PATTERNS = (
    ("amount", r"£\s*([\d,]+(?:\.\d{2})?)\b", 0.9),
    ("amount", r"\$\s*([\d,]+(?:\.\d{2})?)\b", 0.9),
    ("amount", r"€\s*([\d,]+(?:\.\d{2})?)\b", 0.9),
    ("case_ref", r"\[(\d{4})\]\s*EWHC\s*(\d+)\s*\(([A-Za-z]+)\)", 0.95),
    ("case_ref", r"\[(\d{4})\]\s*EWCA\s*(Civ|Crim)\s*(\d+)", 0.95),
    ("case_ref", r"\[(\d{4})\]\s*UKSC\s*(\d+)", 0.95),
    ("case_ref", r"\b([A-Z]{2}\d{2}[A-Z]\d{5})\b", 0.95),
    ("organization", r"\b([A-Z][A-Za-z\s&]+)\s+(?:Limited|Ltd|LLP|PLC|plc)\b", 0.85),
    ("person", r"\b(Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Dame|Lord|Lady)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", 0.8),
    ("document_ref", r"(?i)\b(Exhibit\s+[A-Z0-9]+)\b", 0.9),
    ("document_ref", r"(?i)\b(Appendix\s+[A-Z0-9]+)\b", 0.9),
    ("document_ref", r"(?i)\b(Schedule\s+[A-Z0-9]+)\b", 0.9),
    ("email_address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
)
#: What every match of a pattern holds one of.
NEEDED = {PATTERNS[7][1]: ("Limited", "Ltd", "LLP", "PLC", "plc"), PATTERNS[3][1]: ("EWHC",), PATTERNS[4][1]: ("EWCA",), PATTERNS[5][1]: ("UKSC",), PATTERNS[12][1]: ("@",),
          PATTERNS[0][1]: ("£",), PATTERNS[1][1]: ("$",), PATTERNS[2][1]: ("€",)}


def entities(docs: DataFrame, id_col: str, text_col: str, patterns=PATTERNS) -> DataFrame:
    """(id, kind, name, confidence, mentions): one scan, an array of matches a pattern, pre-aggregated by key."""

    def matches(kind: str, pattern: str, confidence: float):
        text = F.coalesce(F.col(text_col), F.lit(""))
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if needs := NEEDED.get(pattern):  # a match holds one of these, and looking for them costs a scan, not a try at every capital letter
            found = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needs]), found).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"), F.lit(confidence).alias("confidence")))

    found = F.concat(*[matches(*p) for p in patterns])
    rows = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("e")).select("id", "e.*")
    return rows.groupBy("id", "kind", "name", "confidence").agg(F.count("*").alias("mentions"))


def year_headings(events: DataFrame, group: str, day: str, id_col: str) -> DataFrame:
    """Events newest first, with a mark where the year changes."""
    by = W.partitionBy(group).orderBy(F.desc(day), id_col)
    year = F.year(day)
    return events.withColumn("new_year", F.coalesce(F.lag(year).over(by) != year, F.lit(True)))
