"""File sources: folders of mail, word-processor, spreadsheet and text files become one documents table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.functions.text import document_key

SCHEMA = "path string, file_name string, kind string, text string, metadata map<string,string>, error string"
HEADERS = ("From", "To", "Cc", "Bcc", "Subject", "Date", "Message-ID")


def parse_mail(raw: bytes) -> tuple[str, dict]:
    """The first plain part, else the first HTML part without tags; attachments are skipped."""
    import email
    from email import policy

    message = email.message_from_bytes(raw, policy=policy.default)
    part = message.get_body(("plain", "html"))
    body = part.get_content() if part is not None else ""
    if part is not None and part.get_content_type() == "text/html":
        body = re.sub("<[^>]+>", "", body)
    return body, {h: str(message[h]) for h in HEADERS if message[h]}


def parse_docx(raw: bytes) -> tuple[str, dict]:
    """Paragraphs in body order; a heading is a line of its own after "## " and names the section of what follows; table cells are joined by bars."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out, sections = [], []
    for item in body if body is not None else ():
        if item.tag == f"{w}p":
            style = item.find(f"{w}pPr/{w}pStyle")
            heading = style is not None and (style.get(f"{w}val") or "").lower().startswith("heading")
            if heading and text(item).strip():
                sections.append(text(item).strip())
                out.append(f"## {sections[-1]}")
            else:
                out.append(text(item))
        elif item.tag == f"{w}tbl":
            out += [" | ".join(text(c) for c in row.iter(f"{w}tc")) for row in item.iter(f"{w}tr")]
    return "\n\n".join(x for x in out if x.strip()), {"sections": " | ".join(sections)} if sections else {}


def parse_pdf(raw: bytes) -> tuple[str, dict]:
    """The pages' texts, with their number and whether the first are empty (scanned); needs the optional pypdf."""
    import io

    import pypdf

    pages = [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages]
    first = pages[:3]
    scanned = bool(first) and sum(not p.strip() for p in first) / len(first) >= 0.8
    return "\n\n".join(p.strip() for p in pages if p.strip()), {"pages": str(len(pages)), "scanned": str(scanned).lower()}


def sheet_rows(raw: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of each sheet of an xlsx workbook, in workbook order; gaps are empty texts."""
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    book = zipfile.ZipFile(io.BytesIO(raw))
    tree = lambda name: ElementTree.fromstring(book.read(name))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{main}t"))
    shared = [text(e) for e in tree("xl/sharedStrings.xml").iter(f"{main}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    places = {e.get("Id"): posixpath.normpath(posixpath.join("/xl", e.get("Target"))).lstrip("/") for e in tree("xl/_rels/workbook.xml.rels")}
    for sheet in tree("xl/workbook.xml").iter(f"{main}sheet"):
        rows = []
        for row in tree(places[sheet.get(rel)]).iter(f"{main}row"):
            cells: dict[int, str] = {}
            for cell in row.iter(f"{main}c"):
                letters = re.match("[A-Z]*", cell.get("r") or "").group()
                at = len(cells)
                if letters:
                    at = -1
                    for letter in letters:
                        at = (at + 1) * 26 + ord(letter) - 65
                value = cell.find(f"{main}v")
                kind, found = cell.get("t"), "" if value is None else value.text or ""
                cells[at] = shared[int(found)] if kind == "s" and found else text(cell) if kind == "inlineStr" else found
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        yield sheet.get("name"), rows


def parse_sheets(raw: bytes, sample: int = 10) -> tuple[str, dict]:
    """A paragraph for each sheet: its name, the header row, the first rows, and how many more there are."""
    out, names = [], []
    for name, rows in sheet_rows(raw):
        names.append(name)
        lines = [f"Sheet: {name}", "=" * 50]
        if len(rows) < 2:
            lines += ["(Empty sheet)"]
        else:
            shown = rows[1 : sample + 1]
            lines += [f"Headers: {' | '.join(rows[0])}", f"\nFirst {len(shown)} rows:"]
            lines += [f"  Row {k}: {' | '.join(r)}" for k, r in enumerate(shown, 1)]
            if len(rows) - 1 > sample:
                lines.append(f"\n... ({len(rows) - 1 - sample} more rows)")
        out.append("\n".join(lines))
    return "\n\n".join(out), {"sheets": ", ".join(names)}


def parse_text(raw: bytes) -> tuple[str, dict]:
    return raw.decode("utf-8", "replace"), {}


PARSERS = {"pdf": parse_pdf, "eml": parse_mail, "docx": parse_docx, "xlsx": parse_sheets, "txt": parse_text, "md": parse_text}


def register(extension: str, parser: Callable[[bytes], tuple[str, dict]]) -> None:
    """Take files of a further kind; the parser turns bytes to a text and metadata. It replaces one that is there."""
    PARSERS[extension.lower().lstrip(".")] = parser


def documents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """A row for each file that a parser takes; a file that cannot be read keeps its error."""

    parsers = dict(PARSERS)  # as it is now

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"]):
                name = path.rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    text, meta = parsers[kind](raw)
                    rows.append((path, name, kind, text, meta, None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, name, kind, None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "file_name", "kind", "text", "metadata", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    known = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*PARSERS))
    return known.select("path", "content").mapInPandas(run, SCHEMA).withColumn("document_id", document_key(F.col("path")))


def json_lines(spark: SparkSession, path: str, schema: str, broken: str | None = "broken") -> DataFrame:
    """A JSONL log without blank lines. Broken lines stay, with their text in the column `broken` names; with None they are dropped."""
    if broken is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(f"{schema}, {broken} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files, each an object or an array of them; a broken file gives no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


#: Fields of an evaluation query.
EVALUATION = ("query_id string, query string, ground_truth_chunks array<string>, ground_truth_citations array<struct<file_name:string,page_number:int,paragraph_number:int>>, should_refuse boolean, context map<string,string>")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries of a JSON file; lists that lack are empty and should_refuse is false."""
    rows = json_documents(spark, path, EVALUATION)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("query_id", "query", empty("ground_truth_chunks"), empty("ground_truth_citations"), F.coalesce("should_refuse", F.lit(False)).alias("should_refuse"), "context")


def synthetic_evaluation(spark: SparkSession, documents: int = 3, chunks: int = 8) -> tuple[DataFrame, DataFrame]:
    """Made-up chunks and queries of one answer each, and a last query without one, to try an evaluation with."""
    places = ["mill", "harbour", "orchard", "quarry", "bridge", "station", "market", "tower"]
    rows = [(f"chunk_{k + 1:03}", f"doc_{k % documents + 1}", f"file{k % documents + 1}.pdf", f"The {places[k % 8]} opened in {1900 + k}.", k // documents + 1, 1) for k in range(chunks)]
    asked = [(f"q{k + 1}", f"When did the {places[k % 8]} open?", [rows[k][0]], [(rows[k][2], rows[k][4], 1)], False, None) for k in range(min(4, chunks))]
    asked.append((f"q{len(asked) + 1}", "Who owns the moon?", [], [], True, None))
    return spark.createDataFrame(rows, "chunk_id string, document_id string, file_name string, text string, page_number int, paragraph_number int"), spark.createDataFrame(asked, EVALUATION)
