"""Text expressions: tokens, ids, previews, slugs and estimates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; accents stay."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda t: t != "")


def trimmed(text: Column) -> Column:
    """Strip of all white space, which trim() alone doesn't do."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def document_key(path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(path), 1, 8))


def chunk_key(document: Column, start: Column, text: Column) -> Column:
    return F.concat(document, F.lit("_"), F.substring(F.md5(F.concat(start.cast("string"), F.lit(":"), text)), 1, 12))


def window_key(document: Column, number: Column) -> Column:
    return F.substring(F.sha2(F.concat(document.cast("string"), F.lit(":chunk:"), number.cast("string")), 256), 1, 16)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def preview(text: Column, most: int = 100) -> Column:
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(text) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def safe_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"[^A-Za-z0-9]", "_"), F.lit("_"), F.substring(F.md5(name), 1, 8))


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_\s-]", ""), r"\s+", "-"), 1, 20)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def first_date(text: Column) -> Column:
    """The first of: ISO, day/month/year, day.month.year, day-month-year, day month-name year."""
    tries = [(r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
             (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"), (r"\d{1,2} [A-Z][a-z]+ \d{4}", "d MMMM yyyy")]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, p, 0), F.lit("")), F.lit(f))) for p, f in tries])
