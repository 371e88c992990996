"""Around generated answers: guards, channels, fenced JSON, synthesis split, prompts, uncited sentences, averages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from docwright.batches import computed
from docwright.functions.text import preview, trimmed
from docwright.operators.citations import CITED, SENTENCE

#: The patterns of citations and sentences as the built-in functions read them: classes are ASCII's, and the end may be before a last line break.
_PLACES = re.compile(CITED, re.ASCII)
_PIECES = re.compile(SENTENCE.replace("$", "(?=[\x85\u2028\u2029]?\\Z)"), re.ASCII)

#: Phrases of refusals, and of attempts to steer the model.
REFUSALS = ("not found in provided documents", "cannot answer", "sufficient relevant information")
STEERING = ("ignore previous instructions", "act as a", "you are now")


def input_guard(query: Column) -> Column:
    """block for under three characters, warning for attempts to steer the model, else info."""
    short = F.length(trimmed(F.coalesce(query, F.lit("")))) < 3
    return F.when(short, "block").when(F.lower(query).rlike("|".join(STEERING)), "warning").otherwise("info")


def output_guard(valid: Column, total: Column) -> Column:
    """warning where under half of the citations are valid."""
    return F.when((total > 0) & (valid / total < 0.5), "warning").otherwise("info")


def final_channel(text: Column) -> Column:
    """What follows the last final marker up to the next tag; else the bodies of all channels; else the text."""
    final = F.regexp_extract(text, r"(?s).*<\|channel\|>final<\|message\|>(.*?)(?:<\||\z)", 1)
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<\|message\|>(.*?)(?:<\||\z)"), F.lit(1))
    return F.when(F.contains(text, F.lit("<|channel|>final<|message|>")), trimmed(final)).when(F.size(bodies) > 0, trimmed(F.array_join(bodies, "\n"))).otherwise(trimmed(text))


def fenced_json(text: Column, schema: str) -> Column:
    """The object inside a fence, or the text itself, parsed; null where it is broken."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(inside != "", inside).otherwise(text), schema)


def search_words(query: Column) -> Column:
    """A keyword query made safe: other signs become spaces; several bare words are joined by OR."""
    clean = trimmed(F.regexp_replace(F.regexp_replace(query, r"(?U)[^\w\s\"*-]", " "), r"\s+", " "))
    return F.when(clean == "", '""').when(clean.rlike('["*]') | ~F.contains(clean, F.lit(" ")), clean).otherwise(F.array_join(F.split(clean, " "), " OR "))


def age(at: Column, now: Column) -> Column:
    """Just now, minutes, hours, Yesterday, days, then the day and month."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    days = F.floor(s / 86400)
    unit = lambda n, u: F.concat(F.floor(n).cast("string"), F.lit(f"{u} ago"))
    return (F.when(s.isNull(), "").when(days == 0, F.when(s < 60, "Just now").when(s < 3600, unit(s / 60, "m")).otherwise(unit(s / 3600, "h")))
            .when(days == 1, "Yesterday").when(days < 7, unit(days, "d")).otherwise(F.date_format(at, "dd MMM")))


def suggested_label(title: Column, text: Column, file_name: Column) -> Column:
    """The title; else the first line, of 8 to 80 characters; else the file name."""
    line = F.split(trimmed(F.coalesce(text, F.lit(""))), "\n")[0]
    return F.when(trimmed(F.coalesce(title, F.lit(""))) != "", trimmed(title)).when(F.length(line).between(8, 80), line).otherwise(file_name)


def source_map(chunks: DataFrame, group: str, order: list, text: str) -> DataFrame:
    """Chunks with a 1-based source id by group and a preview of 200 characters."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return chunks.withColumn("source_id", nth).withColumn("preview", preview(F.col(text), 200))


def _bare(text: str, slack: int) -> list[tuple[int, str]]:
    """(number, sentence) of the sentences of a text that need a citation and have none; see uncited_sentences."""
    cites = [m.span() for m in _PLACES.finditer(text)]
    starts, out = [first for first, _ in cites], []
    for n, m in enumerate(_PIECES.finditer(text)):
        sentence = m[0].rstrip(" \t\n\x0b\f\r")
        if len(sentence) <= 3 or any(r in sentence.lower() for r in REFUSALS):
            continue
        at = bisect_left(starts, m.start() - slack)  # of those that begin late enough the first ends first
        if at == len(cites) or cites[at][1] > m.start() + len(sentence) + slack:
            out.append((n, sentence))
    return out


def uncited_sentences(responses: DataFrame, id_col: str, text_col: str, slack: int = 10) -> DataFrame:
    """(id, number, sentence) of over three characters without a citation inside, or within `slack` of, its bounds.

    A response is read where it stands; refusal phrases need no citation.
    """
    rows = responses.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                found = [_bare(t, slack) for t in some.column(1).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                columns = [pa.array([x[c] for f in found for x in f], kind) for c, kind in ((0, pa.int32()), (1, pa.string()))]
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), *columns], names=["id", "number", "sentence"])

    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("number", IntegerType()), StructField("sentence", StringType())]))


def with_uncited(responses: DataFrame, text_col: str, name: str, slack: int = 10) -> DataFrame:
    """responses with the number of their uncited sentences."""
    return computed(responses, [F.coalesce(F.col(text_col), F.lit(""))], lambda texts: ([len(_bare(t, slack)) for t in texts],), [StructField(name, LongType())])


def log_errors(lines: DataFrame, file: str, number: str, text: str, after: int = 3, most: int = 10) -> DataFrame:
    """(file, number, context): the last `most` lines a file with an error word, each with up to `after` lines that follow."""
    by = W.partitionBy(file).orderBy(number)
    following = F.concat_ws("\n", F.col(text), *[F.lead(text, k).over(by) for k in range(1, after + 1)])
    hits = lines.withColumn("context", following).filter(F.col(text).rlike("ERROR|Exception|Traceback|CRITICAL"))
    nth = F.row_number().over(W.partitionBy(file).orderBy(F.desc(number)))
    return hits.withColumn("_n", nth).filter(F.col("_n") <= most).select(file, number, "context")
