"""Matches with their places, by one pass of a pattern over a text: as a column, and as table functions for lateral joins in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

SPANS = "array<struct<start:int,found:string>>"


def spans(text: Column, pattern: str) -> Column:
    """An array of (start, found): matches with their 0-based places; null for null. Classes and borders are ASCII's, as in the built-in functions."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, re.ASCII)
        return texts.map(lambda t: None if t is None else [{"start": m.start(), "found": m[0]} for m in compiled.finditer(t)])

    return find(text)


class TextMatches:
    """text_matches(text, pattern, around): (number, start, stop, found, context) for each match, with up to `around` characters on either side."""

    def eval(self, text: str, pattern: str, around: int) -> Iterator[tuple]:
        if text is None:
            return
        for n, m in enumerate(re.compile(pattern, re.ASCII).finditer(text)):
            yield n, m.start(), m.end(), m[0], text[max(0, m.start() - around) : m.end() + around]


class TextChunks:
    """text_chunks(text, size, overlap): (number, start, stop, chunk) of the adaptive chunker."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        from docwright.operators.chunking import cut_points

        for n, (start, chunk) in enumerate(cut_points(text or "", size, overlap)):
            yield n, start, start + len(chunk), chunk


class TextSentences:
    """text_sentences(text): (number, start, sentence), cut after . ! or ? before white space or the end."""

    def eval(self, text: str) -> Iterator[tuple]:
        for n, m in enumerate(re.finditer(r"\S(?:.*?[.!?](?=\s|$)|.*\S)", text or "", re.S)):
            yield n, m.start(), m[0]


TABLES = {
    "text_matches": (TextMatches, "number int, start int, stop int, found string, context string"),
    "text_chunks": (TextChunks, "number int, start int, stop int, chunk string"),
    "text_sentences": (TextSentences, "number int, start int, sentence string"),
}


def register_tables(spark: SparkSession) -> list[str]:
    """Make the table functions known to SQL: SELECT ... FROM docs, LATERAL text_matches(text, '[0-9]+', 20)."""
    for name, (made, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(made, returnType=schema, useArrow=True))
    return sorted(TABLES)
