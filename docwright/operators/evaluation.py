"""Retrieval evaluation: recall, citation accuracy, refusal accuracy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def recall_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Found share of the distinct truth within the first k; an empty truth counts as found."""
    hits = F.size(F.array_intersect(F.slice(retrieved, 1, k), truth))
    return F.when(F.size(truth) == 0, 1.0).otherwise(hits / F.size(F.array_distinct(truth)))


def citation_key(file_name: Column, page: Column, paragraph: Column) -> Column:
    """What makes two citations one: the file in lower case, page and paragraph."""
    return F.concat_ws("|", F.lower(F.trim(file_name)), F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(paragraph.cast("string"), F.lit("-")))


def citation_scores(actual: Column, truth: Column) -> dict[str, Column]:
    """accuracy (exact sets), precision and recall, with the empty cases defined."""
    hits, a, t = F.size(F.array_intersect(actual, truth)), F.size(F.array_distinct(actual)), F.size(F.array_distinct(truth))
    return {
        "accuracy": F.when((a == t) & (hits == t), 1.0).otherwise(0.0),
        "precision": F.when(a > 0, hits / a).when(t > 0, 0.0).otherwise(1.0),
        "recall": F.when(t > 0, hits / t).otherwise(1.0),
    }


def refusal_accuracy(refused: Column, should: Column) -> Column:
    return F.avg((refused == should).cast("int"))
