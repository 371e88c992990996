"""Keyed upserts and deletes, batches, rollups, percentiles and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """existing with the rows of new in place of those with their keys; with an order column only the last of a key's new rows."""
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.col(order)).alias("_row")).select("_row.*")
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key), key, "left_anti")


def newest(rows: DataFrame, group: str, *by: Column, most: int) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(group).orderBy(*by))).filter(F.col("_nth") <= most).drop("_nth")


def batches(rows: DataFrame, group: str, order: str, size: int = 8, most: int = 8) -> DataFrame:
    """(group, batch, first, last): runs of `size` rows in order, 1-based, at most `most` batches."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(order))
    numbered = rows.select(group, nth.alias("nth")).withColumn("batch", F.floor((F.col("nth") - 1) / size).cast("int"))
    return numbered.filter(F.col("batch") < most).groupBy(group, "batch").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))


def nearest_rank(values: str, *shares: float) -> list[Column]:
    """sorted[int(n * p)], the last value where that is past the end; for groups of a bounded size."""
    ordered = F.sort_array(F.collect_list(values))
    return [F.element_at(ordered, F.least(F.floor(F.size(ordered) * F.lit(p)).cast("int") + 1, F.size(ordered))).alias(f"p{round(100 * p)}") for p in shares]


def percentiles(rows: DataFrame, group: str, value: str, *shares: float, slack: float = 0.001) -> DataFrame:
    """(group, p50, ...): as nearest_rank, exactly, for groups of any size; nulls don't count.

    Approximate quantiles bracket each rank by `slack` of the group; rows below a bracket are counted and only those within are ranked.
    """
    rows = rows.select(group, F.col(value).alias("v")).filter("v is not null")
    at = [max(0.0, p - slack) for p in shares] + [min(1.0, p + slack) for p in shares]
    stats = rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile_approx("v", at, int(4 / slack)).alias("q"), F.min("v").alias("least"), F.max("v").alias("most"))
    k = len(shares)
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.least(F.floor(F.col("n") * F.lit(p)) + 1, F.col("n")).alias("rank"),
                                  (F.get("q", F.lit(i)) if p > slack else F.col("least")).alias("low"), (F.get("q", F.lit(k + i)) if p + slack < 1 else F.col("most")).alias("high")) for i, p in enumerate(shares)])
    asked = stats.select(F.col(group).alias("_g"), F.explode(brackets).alias("b"))
    met = rows.join(asked, F.col(group).eqNullSafe(F.col("_g")))
    inner = met.filter((F.col("v") >= F.col("b.low")) & (F.col("v") <= F.col("b.high"))).groupBy(group, "b", "v").agg(F.count("*").alias("c"))
    below = met.groupBy(group, "b").agg(F.count_if(F.col("v") < F.col("b.low")).alias("below"))
    upto = F.sum("c").over(W.partitionBy(group, "b").orderBy("v"))
    ranked = inner.withColumn("upto", upto).join(below.select(F.col(group).alias("_g"), F.col("b").alias("_b"), "below"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("b") == F.col("_b")))
    hit = ranked.filter(F.col("below") + F.col("upto") >= F.col("b.rank")).groupBy(group).agg(*[F.min(F.when(F.col("b.i") == i, F.col("v"))).alias(f"p{round(100 * p)}") for i, p in enumerate(shares)])
    return hit


def top_and_other(counts: DataFrame, name: str, count: str, top: int = 8) -> DataFrame:
    by = W.orderBy(F.desc(count), name)  # one row a category
    kept = counts.withColumn("_n", F.row_number().over(by)).withColumn(name, F.when(F.col("_n") <= top, F.col(name)).otherwise("Other"))
    return kept.groupBy(name).agg(F.sum(count).alias(count))


def document_text(chunks: DataFrame, group: str, order: str, text: str, joint: str = "\n\n") -> DataFrame:
    """Chunks of each document joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return chunks.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), joint).alias("text"))


def rekey(edges: DataFrame, mapping: DataFrame, *ends: str) -> DataFrame:
    """Edges with their ends moved to what mapping (old, new) says; loops that a merge makes go."""
    for end in ends:
        m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        edges = edges.join(m, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return edges.filter(F.col(ends[0]) != F.col(ends[1])) if len(ends) == 2 else edges


def induced(edges: DataFrame, nodes: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    for end in (source, target):
        edges = edges.join(nodes.select(F.col(key).alias("_k")), F.col(end) == F.col("_k"), "left_semi")
    return edges


def with_budget(rows: DataFrame, group: str, order: list, tokens: str, most: int) -> DataFrame:
    """Rows of each group while the running sum of tokens stays within the budget."""
    run = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("used", F.sum(tokens).over(run)).filter(F.col("used") <= most)


def update_fields(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with the fields of `new`, which has one row a key, where those are not null."""
    fields = [c for c in existing.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in fields if c in new.columns])
    return existing.join(n, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c != key and c in new.columns else F.col(c) for c in existing.columns])


def children(parents: DataFrame, key: str, suggestions: str, changes: str, notes: str | None = None) -> DataFrame:
    """(parent, kind, value): a row for each suggestion, for each changed setting, and with `notes` for each note."""
    general = parents.select(F.col(key).alias("parent"), F.lit("general").alias("kind"), F.explode(suggestions).alias("value"))
    config = parents.select(F.col(key).alias("parent"), F.explode(changes).alias("k", "v")).select("parent", F.lit("config").alias("kind"), F.concat_ws("=", "k", "v").alias("value"))
    both = general.unionByName(config)
    return both if notes is None else both.unionByName(parents.select(F.col(key).alias("parent"), F.lit("note").alias("kind"), F.explode(notes).alias("value")))


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row or rows of one key; null finds those without one. The filter reaches the scan."""
    return rows.filter(F.col(key).isNull() if value is None else F.col(key) == value)


def metadata_counts(summaries: DataFrame, key: str = "doc_type", meta: str = "metadata", unknown: str = "unknown") -> DataFrame:
    """(kind, n) of a key in the rows' metadata maps."""
    kind = F.coalesce(F.try_element_at(F.col(meta), F.lit(key)), F.lit(unknown))
    return summaries.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def catalog_kpi(records: DataFrame, indexed: str, errored: str) -> DataFrame:
    """(total, indexed, pending, errored, percent) of records with two flags; a null flag is false."""
    done, bad = F.coalesce(indexed, F.lit(False)), F.coalesce(errored, F.lit(False))
    return records.agg(F.count("*").alias("total"), F.count_if(done).alias("indexed"), F.count_if(~done).alias("pending"), F.count_if(bad).alias("errored"), F.round(100.0 * F.count_if(done) / F.nullif(F.count("*"), F.lit(0)), 6).alias("percent"))


def scanned(pages: DataFrame, key: str, page: str, text: str, first: int = 3, share: float = 0.8) -> DataFrame:
    """(key, scanned): whether that share of a document's first pages, numbered from 1, is empty."""
    empty = (F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0).cast("int")
    return pages.filter(F.col(page) <= first).groupBy(key).agg((F.avg(empty) >= share).alias("scanned"))
