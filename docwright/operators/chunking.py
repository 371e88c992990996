"""Chunkers: fixed sliding windows, paragraphs with offsets, and the adaptive recursive chunker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from docwright.functions.text import chunk_key, trimmed, window_key

#: Separators in the order they are tried, and how far around the target a cut may lie.
SEPARATORS, SLACK = ("\n\n", "\n", ". ", " "), 200
#: After more cuts than this a text is sliced.
DEEPEST = 100


def fixed_windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, number, chunk_id, char_start, char_end, chunk): a window every size - overlap characters."""
    step = size - overlap
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("_text"), F.posexplode(starts).alias("number", "char_start"))
    return rows.select("id", "number", window_key(F.col("id"), F.col("number")).alias("chunk_id"), "char_start", (F.col("char_start") + size).alias("char_end"),
                       F.substring("_text", F.col("char_start") + 1, F.lit(size)).alias("chunk"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str, split: str = r"\n\s*\n", joint: int = 2) -> DataFrame:
    """(id, paragraph, text, char_start): non-blank paragraphs and where each begins when joined by `joint` characters."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), split), trimmed), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("paragraph", "text"))
    before = W.partitionBy("id").orderBy("paragraph").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("char_start", F.coalesce(F.sum(F.length("text") + joint).over(before), F.lit(0)))


def place_chunks(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Each chunk with the segment (id, char_start, char_end, page, paragraph) that holds its first character."""
    s = segments.select(F.col("id").alias("_id"), F.col("char_start").alias("_from"), F.col("char_end").alias("_to"), "page", "paragraph")
    on = (F.col("id") == F.col("_id")) & (F.col("char_start") >= F.col("_from")) & (F.col("char_start") < F.col("_to"))
    return chunks.join(s, on, "left").drop("_id", "_from", "_to")


def cut_points(text: str, size: int, overlap: int, deepest: int = DEEPEST) -> list[tuple[int, str]]:
    """(start, chunk) of an adaptive split: cut after the best separator near the target, step back by the overlap.

    Where no separator is near, the rest is cut into windows of `size`; after more than `deepest` cuts, into slices. Blank windows and slices go.
    """
    out, start, depth = [], 0, 0
    while True:
        if depth > deepest:
            return out + [(i, text[i : i + size]) for i in range(start, len(text), size - overlap) if text[i : i + size].strip()]
        if len(text) - start <= size:
            return out + ([(start, text[start:])] if text else [])
        low, high, cut = max(start + 1, start + size - SLACK), start + size + SLACK, -1
        for sep in SEPARATORS:
            at = text.rfind(sep, low, high)
            if at >= 0:
                cut = at + len(sep)
                break
        if cut < 0:
            break
        out.append((start, text[start:cut].rstrip()))
        start, depth = max(start, cut - overlap), depth + 1
    while True:
        stop = min(start + size, len(text))
        if text[start:stop].strip():
            out.append((start, text[start:stop]))
        if stop == len(text):
            return out
        start = max(start + 1, stop - overlap)


def adaptive_chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int, deepest: int = DEEPEST) -> DataFrame:
    """(id, chunk_id, char_start, char_end, chunk)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, a, a + len(c), c) for i, t in zip(frame["id"], frame["text"]) for a, c in cut_points(t or "", size, overlap, deepest)]
            yield pd.DataFrame(rows, columns=["id", "char_start", "char_end", "chunk"])

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, char_start int, char_end int, chunk string")
    return found.withColumn("chunk_id", chunk_key(F.col("id"), F.col("char_start"), F.col("chunk")))
