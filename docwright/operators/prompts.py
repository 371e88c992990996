"""Sources, prompts and batches: citation strings, context assembly, synthesis split, headers, statistics and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docwright.functions.text import estimated_tokens, trimmed
from docwright.session import own_name

#: Kinds of chunks by document kind, and sizes and overlaps in tokens of four characters.
CHUNK_KINDS = {
    "witness_statement": "witness_statement", "pleading": "pleading", "skeleton_argument": "pleading", "expert_report": "witness_statement", "medical_report": "witness_statement",
    "schedule_of_loss": "contract", "contract": "contract", "statute": "statute", "court_filing": "court_filing", "case_law": "court_filing", "case_management": "court_filing",
    "tribunal_document": "court_filing", "regulatory_document": "court_filing", "email": "email", "letter": "email",
}
CHUNK_SIZES = {"witness_statement": (1024, 512), "contract": (768, 384)}
OTHER_SIZE = (512, 256)
#: What a condensed text ends in, and its length before it.
CUT_MARK, CUT_CHARS = "\n\n[... document truncated for length ...]", 32_000


def chunk_kind(document_kind: Column) -> Column:
    return F.coalesce(*[F.when(document_kind == k, v) for k, v in CHUNK_KINDS.items()], F.lit("disclosure"))


def chunk_size(document_kind: Column) -> tuple[Column, Column]:
    """Size and overlap in characters for a document kind."""
    kind = chunk_kind(document_kind)
    pick = lambda n: 4 * F.coalesce(*[F.when(kind == k, v[n]) for k, v in CHUNK_SIZES.items()], F.lit(OTHER_SIZE[n]))
    return pick(0), pick(1)


def segments(docs: DataFrame, id_col: str, text_col: str, paragraphs: str, pages: str) -> DataFrame:
    """(id, char_start, char_end, page, paragraph): paragraphs where there are any, else an equal slice for each distinct page, else the whole text.

    paragraphs is an array of (text, page, paragraph) structs joined by two characters; pages an array of numbers.
    """
    text, paras = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(paragraphs), F.array().cast(docs.schema[paragraphs].dataType))
    numbers = F.sort_array(F.array_distinct(F.coalesce(F.col(pages), F.array().cast("array<int>"))))
    step = F.ceil(F.length(text) / F.greatest(F.size(numbers), F.lit(1))).cast("int")
    n = F.size(numbers)
    slices = F.transform(numbers, lambda p, i: F.struct((i * step).alias("char_start"), F.least((i + 1) * step, F.length(text)).alias("char_end"), p.cast("int").alias("page"), F.lit(None).cast("int").alias("paragraph")))
    whole = F.array(F.struct(F.lit(0).alias("char_start"), F.length(text).alias("char_end"), F.lit(1).alias("page"), F.lit(None).cast("int").alias("paragraph")))
    some = F.size(paras) > 0
    rows = docs.withColumn(own_name(docs, "_row"), F.monotonically_increasing_id())
    cut = rows.filter(~some).select(F.col(id_col).alias("id"), F.explode(F.when(n > 0, slices).otherwise(whole)).alias("s")).select("id", "s.*")
    # Paragraphs' places are a running sum over a document's rows: one pass, where a sum for each of an array's elements is quadratic.
    parts = rows.filter(some).select(F.col(id_col).alias("id"), F.col(own_name(docs, "_row")).alias("_row"), F.posexplode(F.transform(paras, lambda x: F.struct(F.length(x["text"]).alias("n"), x["page"].cast("int").alias("page"), x["paragraph"].cast("int").alias("paragraph")))).alias("_nth", "_p"))
    before = F.coalesce(F.sum(F.col("_p.n") + 2).over(W.partitionBy("_row").orderBy("_nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = parts.withColumn("char_start", before).select("id", "char_start", (F.col("char_start") + F.col("_p.n")).alias("char_end"), "_p.page", "_p.paragraph")
    return placed.unionByName(cut)


def cited_as(file_name: Column, page: Column, paragraph: Column, section: Column, lead: Column | str = "Source: ") -> Column:
    """[Source: name | Page n | Para m | "section"]; a paragraph needs a page, and page or paragraph 0 counts as none."""
    lead = F.lit(lead) if isinstance(lead, str) else lead
    paged = F.when(page > 0, F.concat(F.lit("Page "), page.cast("string")))
    parts = F.array(F.concat(lead, F.coalesce(file_name, F.lit("unknown"))), paged, F.when((page > 0) & (paragraph > 0), F.concat(F.lit("Para "), paragraph.cast("string"))),
                    F.when(section != "", F.concat(F.lit('"'), section, F.lit('"'))))
    return F.concat(F.lit("["), F.array_join(F.array_compact(parts), " | "), F.lit("]"))


def _joined(rows: DataFrame, group: str, order: str, value: Column, joint: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["v"]), joint).alias("text"))


def source_list(chunks: DataFrame, group: str, order: str) -> DataFrame:
    """(group, text): a line for each distinct file, page and paragraph of a query's chunks, where it comes first."""
    first = chunks.groupBy(group, "file_name", "page_number", "paragraph_number").agg(F.min_by(F.struct(order, "section_header"), order).alias("f")).select(group, "file_name", "page_number", "paragraph_number", "f.*")
    return _joined(first, group, order, cited_as(F.col("file_name"), F.col("page_number"), F.col("paragraph_number"), F.col("section_header")), "\n")


def numbered_source_list(chunks: DataFrame, group: str, order: str) -> DataFrame:
    """(group, text): every chunk as Source-1, Source-2 and so on."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(order))
    rows = chunks.withColumn("_n", nth)
    return _joined(rows, group, "_n", cited_as(F.col("file_name"), F.col("page_number"), F.col("paragraph_number"), F.col("section_header"), F.concat(F.lit("Source-"), F.col("_n").cast("string"), F.lit(": "))), "\n")


def prompts(chunks: DataFrame, group: str, order: str) -> DataFrame:
    """(group, text): a query's chunks in order, each under its citation. Where any document has a summary, chunks are gathered by file, in the order the files
    first come, and each summary stands once ahead of its file's chunks."""
    body = F.concat(cited_as(F.col("file_name"), F.col("page_number"), F.col("paragraph_number"), F.col("section_header")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    by_file, by_query = W.partitionBy(group, "file_name"), W.partitionBy(group)
    rows = chunks.withColumns({"_body": body, "_first": F.min(order).over(by_file), "_any": F.max(F.col("document_summary").isNotNull()).over(by_query)})
    head = F.when((F.col(order) == F.col("_first")) & F.col("document_summary").isNotNull(),
                  F.concat(F.lit("=== Document: "), F.coalesce("file_name", F.lit("unknown")), F.lit(" ===\n[Document Overview]\n"), F.col("document_summary"), F.lit("\n\n"))).otherwise(F.lit(""))
    place = F.when(F.col("_any"), F.struct(F.col("_first").alias("a"), F.col(order).alias("b"))).otherwise(F.struct(F.col(order).alias("a"), F.col(order).alias("b")))
    rows = rows.withColumns({"_place": place, "_text": F.when(F.col("_any"), F.concat(head, F.col("_body"))).otherwise(F.col("_body"))})
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_place", "_text"))), lambda x: x["_text"])
    return rows.groupBy(group).agg(F.when(F.first("_any"), F.array_join(parts, "\n")).otherwise(F.array_join(parts, "\n\n")).alias("text"))


def synthesis(text: Column) -> Column:
    """(answer, reasoning): split at the last Summary: heading, else at the last phrase that leads to a conclusion, else the last two fifths of more than two paragraphs are the answer, else all is."""
    whole = F.coalesce(text, F.lit(""))
    heading = r"(?is)^(.*(?:^|\n))(Summary:.*)$"
    turn = r"(?is)^(.*(?:^|\n))((?:Therefore|In conclusion|Final answer|To summarize)[:\s].*)$"
    paras = F.filter(F.transform(F.split(whole, "\n\n"), trimmed), lambda p: p != "")
    at = F.floor(F.size(paras) * F.lit(0.6)).cast("int")
    pair = lambda a, r: F.struct(a.alias("answer"), r.alias("reasoning"))
    part = lambda pattern: pair(trimmed(F.regexp_extract(whole, pattern, 2)), trimmed(F.regexp_extract(whole, pattern, 1)))
    split = pair(F.array_join(F.slice(paras, at + 1, F.size(paras)), "\n\n"), F.array_join(F.slice(paras, F.lit(1), at), "\n\n"))
    return F.when(whole.rlike(heading), part(heading)).when(whole.rlike(turn), part(turn)).when(F.size(paras) > 2, split).otherwise(pair(whole, F.lit("")))


def batch_outputs(outputs: DataFrame, group: str, batch: str, text: str, start: str, end: str, template: str = "Batch {0}/{1} (chunks {2}-{3})") -> DataFrame:
    """(group, text): outputs of batches, whatever order they came in, joined in theirs, each under a header; blank ones are left out."""
    total = F.count("*").over(W.partitionBy(group))
    pieces, values = template, (F.col(batch) + 1, total, F.col(start), F.col(end))
    shown = F.lit(pieces)
    for k, v in enumerate(values):
        shown = F.replace(shown, F.lit("{%d}" % k), v.cast("string"))
    rows = outputs.withColumn("_text", F.concat(shown, F.lit("\n"), trimmed(F.coalesce(text, F.lit("")))))
    return _joined(rows.filter(trimmed(F.coalesce(text, F.lit(""))) != ""), group, batch, F.col("_text"), "\n\n")


def batch_stats(batches: DataFrame, group: str) -> DataFrame:
    """(group, batches, prompt_tokens, prompt_ms, tokens, tokens_per_second) of batches (prompt_tokens, prompt_ms, answer, duration_ms): sums, null where 0; the rate of the answers' estimated tokens."""
    tokens, ms = F.sum(estimated_tokens(F.col("answer"))), F.sum("duration_ms")
    none = lambda c: F.nullif(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    return batches.groupBy(group).agg(F.count("*").alias("batches"), none("prompt_tokens").alias("prompt_tokens"), none("prompt_ms").alias("prompt_ms"), tokens.alias("tokens"),
                                      F.round(tokens / F.nullif(ms / 1000.0, F.lit(0.0)), 6).alias("tokens_per_second"))


def condensed(text: Column, most: int = CUT_CHARS) -> Column:
    """The text a summary is made of: cut with a mark where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


def summary_key(document: Column, kind: Column, level: str = "document") -> Column:
    return F.substring(F.sha2(F.concat_ws(":", document, kind, F.lit(level)), 256), 1, 16)


def summary_minutes(documents: Column, tokens_each: Column, rate: Column) -> Column:
    """Minutes to summarise so many documents of so many tokens at a rate of tokens a second."""
    return F.round(documents * tokens_each / rate / 60, 2)


def first_available(wanted: list[str], available: DataFrame, name: str = "name") -> str | None:
    """The first wanted model that is there."""
    have = {r[0] for r in available.filter(F.col(name).isin(*wanted)).select(name).distinct().collect()}  # as many as are wanted
    return next((w for w in wanted if w in have), None)


def top_summaries(summaries: DataFrame, most: int = 20, chars: int = 500) -> DataFrame:
    """The newest summaries, each cut to so many characters."""
    return summaries.orderBy(F.desc("created_at"), "summary_id").limit(most).withColumn("content", F.substring("content", 1, chars))
