"""Line dedup with native expressions only: hash ranges, secondary sort, keep bitmaps.

A line's key is the line without surrounding ASCII white space, A-Z lower-cased. Every key
of at least `min_chars` code points that occurs in two or more documents loses all its lines
except those of the smallest document id that holds it.

Plan. Lines become (128-bit key hash, id, position) rows. Hashes are uniform, so equal slices
of the 64-bit range are balanced range partitions without a sampling pass; each partition is
sorted by hash, id and position and a running minimum streams the first holder. Hot keys (found
in a sample of documents, with 1 / HOT_SHARE of an even partition's lines or more, so at most HOT_SHARE times the partitions of
them) never enter that sort: an exact map-side-combined minimum over all rows settles them and is
broadcast; of their lines only those that go are shuffled, spread by document. Only dropped positions travel
back, as a sparse bitmap a document; the text is cut into the runs between them.

Defined cases: null or empty text is one empty line; a null id ranks after all ids and all null
ids count as one document; repeated rows of one id are one document; rows with the same id and
different texts get their own bitmaps; an empty table gives an empty result; columns other than
id and text pass through `dedup_documents` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from docwright.session import own_name, shuffle_partitions, table

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_SHARE = 8
SAMPLE_MODULUS = 64
SAMPLE_LEAST = 8
LAST_ID = 2**63 - 1


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(ord_id, th, pos, h1, h2) of the lines whose key is long enough."""
    lines = docs.select(
        F.coalesce(F.col("_id"), F.lit(LAST_ID)).alias("ord_id"), F.xxhash64("_text").alias("th"),
        F.posexplode(F.split("_text", "\n")).alias("pos", "line"),
    )
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return keyed.select("ord_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), F.col("key")).alias("h2"))


def _hot(docs: DataFrame, min_chars: int, parts: int) -> list[int]:
    """Hashes with at least 1 / HOT_SHARE of a partition's share of the sampled lines; this steers the plan, never the result."""
    some = _lines(docs.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(SAMPLE_MODULUS)) == 0), min_chars)
    counts = some.groupBy("h1").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(SAMPLE_LEAST, total // (parts * HOT_SHARE))
    return [r[0] for r in counts.filter(F.col("count") >= least).select("h1").collect()]


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(ord_id, th, drops): for each document that loses lines a sparse bitmap, the sorted positions of those that go."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    parts = shuffle_partitions(spark)
    lines, hot = _lines(docs, min_chars), _hot(docs, min_chars, parts)
    first_id = F.lit(None).cast("long")
    if hot:
        few = F.broadcast(spark.range(1).select(F.explode(F.array(*map(F.lit, hot))).alias("h1")))  # HOT_SHARE times the partitions at most
        first = lines.join(few, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("ord_id").alias("hot_first"))
        lines = lines.join(F.broadcast(first), ["h1", "h2"], "left").filter("hot_first is null or ord_id > hot_first")
        first_id = F.col("hot_first")
    # A hot line that goes is settled here: it is dealt by its document and stands alone in the sort.
    lines = lines.withColumn("settled", first_id.isNotNull())
    own = lambda a, b: F.when(F.col("settled"), F.col(a)).otherwise(F.col(b))
    lines = lines.select("settled", own("ord_id", "h1").alias("g1"), own("pos", "h2").alias("g2"), F.when(F.col("settled"), F.xxhash64("ord_id")).otherwise(F.col("h1")).alias("deal"), "ord_id", "th", "pos")
    slice_of = F.expr(f"cast(shiftrightunsigned(deal, 32) * {parts} / 4294967296 as int)")
    by_hash = W.partitionBy("slice", "settled", "g1", "g2").orderBy("ord_id", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    gone = (
        lines.withColumn("slice", slice_of).drop("deal").repartitionById(parts, F.col("slice"))
        .withColumn("first_id", F.min("ord_id").over(by_hash))
        .filter(F.col("settled") | (F.col("ord_id") > F.col("first_id"))).select("ord_id", "th", "pos")
    )
    return gone.groupBy("ord_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def keep_runs(drops: Column) -> Column:
    """The lengths of the runs of kept lines before each dropped one."""
    return F.transform(drops, lambda p, i: p - F.coalesce(F.get(drops, i - 1), F.lit(-1)) - 1)


def kept_lines(text: Column, drops: Column) -> Column:
    """The lines between the dropped ones, joined by newline: runs are sliced, not lines tested."""

    def cut(lines: Column) -> Column:
        before = lambda i: F.coalesce(F.get(drops, i - 1), F.lit(-1))
        until = lambda i: F.coalesce(F.get(drops, i), F.size(lines))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), lambda i: F.slice(lines, before(i) + 2, until(i) - before(i) - 1))), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n")), cut), F.lit(0))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, names: tuple[str, str, str, str] = ("_kept", "_n_lines", "_n_dropped", "_keep_runs")) -> DataFrame:
    """docs and, called `names`, the kept lines joined by newline, the lines, the dropped ones, and the runs of kept ones."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars)
    ord_, th, drops = (own_name(docs, x) for x in ("_ord", "_th", "_drops"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({ord_: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), th: F.xxhash64(text)})
    joined = keyed.join(maps.select(F.col("ord_id").alias(ord_), F.col("th").alias(th), F.col("drops").alias(drops)), [ord_, th], "left")
    return joined.select(
        *docs.columns,
        F.when(F.col(drops).isNull(), text).otherwise(kept_lines(text, F.col(drops))).alias(names[0]),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(names[1]),
        F.coalesce(F.size(drops), F.lit(0)).cast("long").alias(names[2]),
        keep_runs(F.col(drops)).alias(names[3]),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs whose texts have lost their repeated lines, with the length in chars_col; a null text stays null."""
    names = tuple(own_name(docs, x) for x in ("_kept", "_n_lines", "_n_dropped", "_keep_runs"))
    out = dedup_documents(docs, id_col, text_col, names=names)
    text = F.when(F.col(text_col).isNotNull(), F.col(names[0]))
    return out.withColumns({text_col: text, chars_col: F.coalesce(F.length(text), F.lit(0)).cast("long")}).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


OP6_SQL = """
WITH lines AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key),
flagged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id > f.first_id AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT nullif(doc_id, 9223372036854775807) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
