"""Extension points: jobs by name, generated columns, and the engine's helpers as SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField

from docwright.batches import computed

Generator = Callable[[list[str]], list[str]]
JOBS: dict[str, Callable[..., DataFrame]] = {}


def job(name: str):
    """Register a function that makes a DataFrame under a name."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        JOBS[name] = f
        return f

    return keep


def run_job(name: str, *args, **kwargs) -> DataFrame:
    if name not in JOBS:
        raise KeyError(f"no job {name!r}; there are {sorted(JOBS)}")
    return JOBS[name](*args, **kwargs)


def generated(rows: DataFrame, prompt: str, generator: Generator, out: str = "answer", batch: int = 16) -> DataFrame:
    """rows with what the generator says to each prompt, `batch` at a time; a failed batch gives nulls."""

    def say(prompts: list[str | None]) -> tuple[list[str | None]]:
        said: list[str | None] = []
        for k in range(0, len(prompts), batch):
            asked = prompts[k : k + batch]
            try:
                got = list(generator(asked))
                said += got if len(got) == len(asked) else [None] * len(asked)
            except Exception:  # one bad answer loses its batch and not the job
                said += [None] * len(asked)
        return (said,)

    return computed(rows, [F.col(prompt)], say, [StructField(out, StringType())])


def parsed(rows: DataFrame, answer: str, schema: str, out: str = "parsed") -> DataFrame:
    """rows with the object of each answer, fenced or not; null where it is none."""
    from docwright.operators.answers import fenced_json

    return rows.withColumn(out, fenced_json(F.col(answer), schema))


def answered(rows: DataFrame, prompt: str, generator: Generator, schema: str, tries: int = 3) -> DataFrame:
    """rows with `parsed`, asked again up to `tries` times within the task while an answer is no object of the schema."""

    def again(asked: list[str]) -> list[str]:
        import json

        good = lambda s: s is not None and _object(s, json) is not None
        out = list(generator(asked))
        for _ in range(tries - 1):
            bad = [k for k, s in enumerate(out) if not good(s)]
            if not bad:
                break
            for k, s in zip(bad, generator([asked[k] for k in bad])):
                out[k] = s
        return out

    return parsed(generated(rows, prompt, again), "answer", schema)


def _object(text: str, json):
    import re

    inside = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    try:
        return json.loads(inside[1] if inside else text)
    except ValueError:
        return None


#: Helpers that are expressions of built-in functions.
EXPRESSIONS = {
    "document_key(path STRING) RETURNS STRING": "concat('doc_', substr(md5(path), 1, 8))",
    "text_terms(t STRING) RETURNS ARRAY<STRING>": r"filter(split(lower(coalesce(t, '')), r'[^\p{L}\p{N}]+'), x -> x <> '')",
    "word_overlap(q STRING, t STRING) RETURNS DOUBLE": "size(array_intersect(text_terms(q), text_terms(t))) / greatest(1, size(array_distinct(text_terms(q))))",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make helpers known to SQL text: keys, terms, a word overlap, a name's similarity, and the table functions."""
    import difflib

    from docwright.functions.matches import register_tables

    for head, said in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {said}")

    @F.pandas_udf("double")
    def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)])

    spark.udf.register("name_similarity", name_similarity)
    return sorted([*(h.split("(")[0] for h in EXPRESSIONS), "name_similarity", *register_tables(spark)])
