"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order (null last) take the weights in turn and share all words in
proportion; no source's target passes `most` times its own size, and the excess is reshared by
weight until none is above. A source gives whole epochs first. The rest comes from a weighted
sample without replacement: each document draws the exponential key -ln(u) / quality, documents
are sorted by key within their source, and the prefix whose words reach the remaining budget is
taken, documents whole.

The sort is by ranges of (source, key), so one source with most of the rows spreads over all
partitions; running sums within a range plus the ranges' offsets give the prefix. The outcome is
one row a source (epochs and the last key taken), which a join applies to the documents without
moving any text. Keys come from a hash of the id and the text: reruns agree.

Defined cases: null text has size 0; a null source is a source of its own; a null id hashes as
the empty string; rows equal in id and text have one key and follow each other, so some of them may be taken and others not;
sources without words have target 0 and are not taken; an empty table gives an empty result; other columns pass through `mix`,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from docwright.session import dropped, own_name, saved, shuffle_partitions, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
FIRST_ID = -(2**63)
JUNK = "%$*#&!|"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """The weight where no classifier's score is at hand: the share of letters, times the share of distinct lines, less symbols that mark junk; 0.05 at least, 1 for null."""
    size = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / size
    lines = F.split(text, "\n")
    junk = F.length(text) - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(F.greatest(F.lit(0.05), letters * (F.size(F.array_distinct(lines)) / F.size(lines)) * (1 - 4 * junk / size)), F.lit(1.0))


def sampling_key(id_: Column, text: Column, quality: Column) -> Column:
    """-ln(u) / quality, u from 52 bits of the md5 of the id and the text's md5."""
    said = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(2.0**52)) / quality


def _ranked(df: DataFrame, *by: Column) -> DataFrame:
    """df with _rank, the 0-based place in the order of `by`, from range partitions."""
    spread = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).withColumn("_pid", F.spark_partition_id())
    spread = saved(spread, "ranked")
    counts = spread.groupBy("_pid").count()
    before = counts.select("_pid", (F.sum("count").over(W.orderBy("_pid")) - F.col("count")).alias("_before"))  # a row a partition
    nth = F.row_number().over(W.partitionBy("_pid").orderBy(*by)) - 1
    return spread.withColumn("_nth", nth).join(before, "_pid").withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_pid", "_nth", "_before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size) with target, by filling to a common level under the caps."""
    ranked = _ranked(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = saved(ranked.withColumn("w", weight), "sources")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped, cap = 0.0, -1, most * F.col("source_size")
    while total > 0:
        full = F.lit(level) * F.col("w") > cap
        n, used, rest = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, cap)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - (used or 0)) / rest
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("w")).alias("target"))


def mix_plan(docs: DataFrame, quality: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, number: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (_id, source, size, at) and the plan (source, source_size, target, epochs, cut).

    A document is taken `epochs` times, and once more if its place `at` is not beyond `cut`. Places differ in a row's number, so that equal
    rows lie in any number of ranges and a cut can fall among them; which of them is taken doesn't matter.
    """
    number = F.monotonically_increasing_id() if number is None else number
    narrow = saved(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
                               place(F.col(id_col), F.col(text_col), quality, number).alias("at")), "mix-rows")
    plan = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = saved(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    ranged = narrow.repartitionByRange(shuffle_partitions(docs.sparkSession), "source", "at").withColumn("pid", F.spark_partition_id())
    ranged = saved(ranged.select("pid", "source", "at", "size"), "mix-ranges")
    sums = ranged.groupBy("pid", "source").agg(F.sum("size").alias("in_range"))
    before = sums.withColumn("before", F.sum("in_range").over(W.partitionBy("source").orderBy("pid")) - F.col("in_range"))
    offsets = before.join(plan.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("pid").alias("_p"), F.col("source").alias("_s"), "before", "rest")
    upto = F.sum("size").over(W.partitionBy("pid", "source").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    prefix = ranged.withColumn("upto", upto).join(offsets, (F.col("pid") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    taken = prefix.filter(2.0 * (F.col("before") + F.col("upto")) - F.col("size") <= 2.0 * F.col("rest"))
    cuts = taken.groupBy(F.col("source").alias("_s")).agg(F.max("at").alias("cut"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "epochs", "cut")
    plan = saved(plan, "mix-plan")
    dropped(ranged)
    return narrow, plan


def place(id_: Column, text: Column, quality: Column, number: Column) -> Column:
    return F.struct(sampling_key(id_, text, quality).alias("key"), F.coalesce(id_.cast("long"), F.lit(FIRST_ID)).alias("ord_id"), words(text).alias("size"), number.alias("number"))


def copies() -> Column:
    return (F.col("epochs") + F.coalesce((F.col("at") <= F.col("cut")).cast("long"), F.lit(0))).cast("long")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_plan_source")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_plan_source"))).withColumn("copies", copies()).drop("_plan_source")


def mix(docs: DataFrame, quality: Column | None = None, number: str | None = None) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; extra columns pass through, whatever their names.

    `quality` weighs a document; without it `quality_weight` of its text does. `number` is a column that tells rows apart
    and is the same on every reading; without it docs are saved with one.
    """
    quality = quality_weight(F.col("text")) if quality is None else F.greatest(quality, F.lit(0.01))
    columns = docs.columns
    if number is None:
        number = own_name(docs, "_number")
        docs = saved(docs.withColumn(number, F.monotonically_increasing_id()), "mix-docs")
    narrow, plan = mix_plan(docs, quality, number=F.col(number))
    dropped(narrow)
    mark = "_mix"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    plan = plan.select(*[F.col(c).alias(f"{mark}_{c}") for c in plan.columns])
    at = place(F.col("doc_id"), F.col("text"), quality, F.col(number))
    n = F.col(f"{mark}_epochs") + F.coalesce((at <= F.col(f"{mark}_cut")).cast("long"), F.lit(0))
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col(f"{mark}_source")))
    return joined.withColumn(f"{mark}_turn", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow, plan = mix_plan(docs, quality_weight(F.col("text")))
    out = with_copies(narrow, plan)
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / coalesce(greatest(0.05::DOUBLE, length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / greatest(length(text), 1)
        * (len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10))))
        * (1 - (4 * (length(text) - length(translate(text, '%$*#&!|', ''))))::DOUBLE / greatest(length(text), 1))), 1) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 3 * source_size / w AS ratio, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS nth, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
    sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM sources),
level AS (SELECT coalesce(arg_min((total - used) / rest_w, nth) FILTER (WHERE (total - used) / rest_w <= ratio), 0) AS level FROM filled),
goals AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * w) AS target FROM filled, level),
ranked AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN 2.0::DOUBLE * upto - size <= 2.0::DOUBLE * (target - epochs * source_size) THEN size ELSE 0 END)::BIGINT AS taken
FROM ranked
"""
