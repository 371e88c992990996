"""Citations in responses: parse, inline markers, sentences, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docwright.functions.text import trimmed
from docwright.session import task_partitions

#: A verbose citation, an inline marker and a sentence.
CITED = r'(?i)\[Source:\s*([^|]+)\s*\|\s*(?:Page\s+(\d+)(?:,\s*Para\s+(\d+))?)?\s*(?:\|\s*"([^"]+)")?\s*\]'
INLINE = r"(?i)\[\[@Source-(\d+)\]\]"
SENTENCE = r"(?s).+?[.!?](?:\s+|$)"


def citations(responses: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, file_name, page_number, paragraph_number, section_title) of every verbose citation; page, paragraph and section may lack."""
    return _read(responses.select(F.col(id_col).alias("id"), F.posexplode(_cited(F.col(text_col))).alias("position", "c")), "id")


def _cited(text: Column) -> Column:
    """The parts of each verbose citation of a text."""
    part = lambda n: F.regexp_extract_all(text, F.lit(CITED), F.lit(n))
    return F.arrays_zip(part(1).alias("f"), part(2).alias("p"), part(3).alias("q"), part(4).alias("s"))


def _read(rows: DataFrame, *kept: str) -> DataFrame:
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') as int)")
    return rows.select(*kept, "position", trimmed(F.col("c.f")).alias("file_name"), number("c.p").alias("page_number"), number("c.q").alias("paragraph_number"), F.nullif("c.s", F.lit("")).alias("section_title"))


def inline_sources(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(INLINE), F.lit(1)), lambda x: x.cast("int"))


def inline_citations(responses: DataFrame, id_col: str, text_col: str, sources: DataFrame) -> DataFrame:
    """(id, position, source_id, chunk_id): inline markers with the source (id, source_id, chunk_id) they number; chunk_id is null for a marker without one."""
    rows = responses.select(F.col(id_col).alias("id"), F.posexplode(inline_sources(F.col(text_col))).alias("position", "source_id"))
    return rows.join(sources.select("id", "source_id", "chunk_id"), ["id", "source_id"], "left").select("id", "position", "source_id", "chunk_id")


def sentences(responses: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, sentence) of more than three characters."""
    rows = responses.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE), F.lit(0))).alias("number", "sentence"))
    return rows.withColumn("sentence", F.regexp_replace("sentence", r"\s+$", "")).filter(F.length("sentence") > 3)


def citable(chunks: DataFrame, threshold: float, order: str) -> DataFrame:
    """Chunks (file_name, page_number, paragraph_number, chunk_id, score) that reach the threshold; of several at one place the last in order."""
    key = ["file_name", "page_number", "paragraph_number"]
    last = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))
    return chunks.filter(F.col("score") >= threshold).withColumn("_n", last).filter("_n = 1").drop("_n")


def _place(lone: Column | None = None) -> Column:
    """File, page and paragraph as one key; without a file it is null, or one of `lone` that no chunk has."""
    parts = lambda f, p, q: F.struct(f.alias("file_name"), p.alias("page_number"), q.alias("paragraph_number"))
    own = F.when(F.col("file_name").isNotNull(), parts(F.col("file_name"), F.col("page_number"), F.col("paragraph_number")))
    return own if lone is None else own.otherwise(parts(F.lit(None).cast("string"), lone, F.lit(None).cast("int")))


def _met(found: DataFrame, known: DataFrame, partitions: int) -> DataFrame:
    """Citations with the columns of known (_place, ...), which is dealt by _place: they stream past the places of their partition and are not sorted."""
    lone = F.pmod(F.xxhash64(*found.columns), F.lit(2**31 - 1)).cast("int")
    return found.withColumn("_place", _place(lone)).repartition(partitions, "_place").join(known.hint("shuffle_hash"), "_place", "left").drop("_place")


def placed(found: DataFrame, chunks: DataFrame, rows: int | None = None) -> DataFrame:
    """Citations with the chunk_id of the chunk of the same file, page and paragraph, null where there is none; chunks has one row a place.

    rows: of both tables, to deal them to tasks of one size; they are counted where it isn't given.
    """
    n = task_partitions(found.sparkSession, found.count() + chunks.count() if rows is None else rows)
    known = chunks.filter("file_name is not null").select(_place().alias("_place"), "chunk_id").repartition(n, "_place")
    return _met(found, known, n)


def verified(found: DataFrame, chunks: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, n_citations, n_missing, verified): citations without a chunk of the same file, page and paragraph are missing; rows as for `placed`."""
    n = task_partitions(found.sparkSession, found.count() + chunks.count() if rows is None else rows)
    known = chunks.filter("file_name is not null").select(_place().alias("_place")).repartition(n, "_place").distinct().withColumn("known", F.lit(True))
    met = _met(found.select("id", "file_name", "page_number", "paragraph_number"), known, n).select("id", F.col("known").isNull().alias("missing")).repartition(n, "id")
    return met.groupBy("id").agg(F.count("*").alias("n_citations"), F.count_if("missing").alias("n_missing")).withColumn("verified", F.col("n_missing") == 0)


def verify(responses: DataFrame, id_col: str, text_col: str, chunks: DataFrame, threshold: float = 0.7, order: str = "position", check_sentences: bool = True, sources: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(id, n_citations, n_missing, n_uncited, verified): a row for each response.

    Missing are citations that no chunk at or over the threshold bears out, and with `sources` also inline markers that
    number none; uncited are sentences without a citation. A response without either is verified. rows: of citations and chunks, as for `placed`.
    """
    from docwright.operators.answers import with_uncited

    # A response is read once: its sentences are counted where it stands, and only its citations meet the chunks.
    said = responses.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    said = with_uncited(said, "text", "uncited") if check_sentences else said.withColumn("uncited", F.lit(0))
    said = said.select("id", "uncited", F.posexplode_outer(_cited(F.col("text"))).alias("position", "c"))
    found = placed(_read(said, "id", "uncited"), citable(chunks, threshold, order), rows)
    cited, once = F.col("position").isNotNull(), F.coalesce(F.col("position") == 0, F.lit(True))
    each = found.select("id", cited.cast("int").alias("n"), (cited & F.col("chunk_id").isNull()).cast("int").alias("missing"), F.when(once, F.col("uncited")).otherwise(0).alias("uncited"))
    if sources is not None:
        marks = inline_citations(responses, id_col, text_col, sources)
        each = each.unionByName(marks.select("id", F.lit(0).alias("n"), F.col("chunk_id").isNull().cast("int").alias("missing"), F.lit(0).alias("uncited")))
    each = each if rows is None else each.repartition(task_partitions(each.sparkSession, rows), "id")
    out = each.groupBy("id").agg(F.sum("n").alias("n_citations"), F.sum("missing").alias("n_missing"), F.sum("uncited").alias("n_uncited"))
    return out.withColumn("verified", (F.col("n_missing") == 0) & (F.col("n_uncited") == 0))
