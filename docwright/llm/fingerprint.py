"""Document fingerprints with native expressions only: a Merkle tree over paragraphs and sections.

A paragraph is a line; its node is the MD5 of its text, and below it are its leaves, short hashes of
pieces (up to four words, ended early by a sentence end). A section is a run of paragraphs that ends where a
paragraph's own hash says so, one in eight, so an inserted line changes one section and moves
none. A section hashes its nodes and the root its sections, in 128 bits each. A fingerprint is the text
    root / section hashes / node:leaves by paragraph
so equal roots mean equal texts. Where roots differ, `with_differences` descends: to sections that the
other tree lacks, and in them to paragraphs that it lacks. Likeness descends too: shared paragraphs count with all
their leaves, of the others the leaves are compared; it is the Dice share of what is common, 1 for equal roots.

Each document's successor in id order comes without a global sort: exact ids at approximate
quantiles cut the id range into one bucket a partition, the first document of a bucket is also
sent to the bucket before it, and a window within each bucket does the rest. The text moves once.

Defined cases: null text is empty; a null id ranks first; equal ids rank by text hash; one
document is its own successor; an empty table gives an empty result; a paragraph that only moves is no difference, but
the sections around it are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from docwright.session import shuffle_partitions, table

LEAF = r"(?:[^\s.!?|]{1,60}[ \t]*){1,4}[.!?|]*\s*|[\s.!?|]+"
#: A node that ends in one of these ends its section.
ENDS = ("0", "8")
FIRST_ID = -(2**63)


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the fingerprint of `text_col`; each level of the tree is a projection of its own."""
    p = f"_{out}"
    leaf = lambda x: _hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)), 8)
    df = df.withColumn(f"{p}_paras", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    df = df.withColumn(f"{p}_leaves", F.transform(f"{p}_paras", lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(LEAF), F.lit(0)), leaf), "")))
    df = df.withColumn(f"{p}_nodes", F.transform(f"{p}_paras", F.md5))
    last = F.size(f"{p}_nodes") - 1
    df = df.withColumn(f"{p}_ends", F.filter(F.transform(f"{p}_nodes", lambda x, i: F.when(F.substring(x, 32, 1).isin(*ENDS) | (i == last), i)), lambda i: i.isNotNull()))
    before = lambda i: F.coalesce(F.get(f"{p}_ends", i - 1), F.lit(-1))
    df = df.withColumn(f"{p}_sections", F.transform(f"{p}_ends", lambda e, i: F.md5(F.array_join(F.slice(f"{p}_nodes", before(i) + 2, e - before(i)), ""))))
    root = F.substring(F.sha2(F.array_join(f"{p}_sections", ""), 256), 1, 32)
    paras = F.array_join(F.zip_with(f"{p}_nodes", f"{p}_leaves", lambda n, x: F.concat(n, F.lit(":"), x)), ".")
    df = df.withColumn(out, F.concat_ws("/", root, F.array_join(f"{p}_sections", "."), paras))
    return df.drop(*(f"{p}_{x}" for x in ("paras", "leaves", "nodes", "ends", "sections")))


def _part(fingerprint: str, n: int) -> Column:
    return F.split(F.element_at(F.split(F.col(fingerprint), "/"), n), r"\.")


def _let(value: Column, then) -> Column:
    """then(value), with the value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _differing(mine: str, other: str) -> Column:
    """0-based places of what the other array lacks: both are sorted together, the other's first among equals, so a run of equals that starts with one of mine is missing there."""
    tagged = F.concat(F.transform(F.array_distinct(other), lambda x: F.struct(x.alias("x"), F.lit(-1).alias("i"))), F.transform(mine, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def places(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda e, p: F.when((p == 0) | (F.get(rows, p - 1)["x"] != e["x"]), p)), lambda p: p.isNotNull())
        runs = lambda s: F.transform(s, lambda a, k: F.slice(rows, a + 1, F.coalesce(F.get(s, k + 1), F.size(rows)) - a))
        missing = lambda s: F.flatten(F.filter(runs(s), lambda run: F.get(run, F.lit(0))["i"] >= 0))
        return _let(starts, lambda s: F.array_sort(F.transform(missing(s), lambda e: e["i"])))

    return _let(F.array_sort(tagged), places)


def with_differences(df: DataFrame, a: str, b: str, sections: str, paragraphs: str) -> DataFrame:
    """df with the 0-based numbers of b's sections that a lacks, and of the paragraphs in them that a lacks; empty for equal roots."""
    parts = {f"_{sections}_{x}{n}": _part(c, n) for x, c in (("a", a), ("b", b)) for n in (2, 3)}
    df = df.withColumns(parts)
    same = F.substring_index(F.col(a), "/", 1) == F.substring_index(F.col(b), "/", 1)
    none = F.array().cast("array<int>")
    of = lambda n: F.when(same, none).otherwise(_differing(f"_{sections}_b{n}", f"_{sections}_a{n}"))
    return df.withColumns({sections: of(2), paragraphs: of(3)}).drop(*parts)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the likeness (0 to 1) of the fingerprints in columns a and b."""
    pa, pb, shared = f"_{out}_a", f"_{out}_b", f"_{out}_shared"
    df = df.withColumns({pa: _part(a, 3), pb: _part(b, 3)})
    leaves = lambda mine, other: F.array_distinct(F.regexp_extract_all(F.array_join(F.transform(F.array_except(mine, other), lambda x: F.substring(x, 34, 2**31 - 1)), ""), F.lit("[0-9a-f]{8}"), F.lit(0)))
    whole = F.aggregate(F.array_intersect(pa, pb), F.lit(0), lambda n, x: n + F.floor((F.length(x) - 33) / 8).cast("int"))
    df = df.withColumns({shared: whole, f"{pa}l": leaves(pa, pb), f"{pb}l": leaves(pb, pa)})
    total = 2 * F.col(shared) + F.size(f"{pa}l") + F.size(f"{pb}l")
    share = 2.0 * (F.col(shared) + F.size(F.array_intersect(f"{pa}l", f"{pb}l"))) / F.greatest(total, F.lit(1))
    same = F.substring_index(F.col(a), "/", 1) == F.substring_index(F.col(b), "/", 1)
    return df.withColumn(out, F.when(same, F.lit(1.0)).otherwise(share)).drop(pa, pb, shared, f"{pa}l", f"{pb}l")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, fingerprint, next_text, next_fingerprint), the successor in ascending id order, cyclic."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))
    docs = docs.select(F.col(id_col).alias("_id"), ids.alias("_ord"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = docs.agg(F.min("_ord"), F.percentile_approx("_ord", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()
    bounds = sorted({found[0], *(found[1] or [])} - {None}) or [0]
    bound_array = F.array(*[F.lit(b) for b in bounds])
    docs = docs.withColumn("_bucket", F.size(F.filter(bound_array, lambda b: b <= F.col("_ord"))) - 1)
    here = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"), F.lit(0).alias("wrapped"))
    before = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(1).alias("guest"), (F.col("_bucket") == 0).cast("int").alias("wrapped"))
    at = F.when(F.array_contains(bound_array, F.col("_ord")), F.array(here, before)).otherwise(F.array(here))
    spread = docs.withColumn("_at", F.explode(at)).select("_id", "_ord", "_text", "_at.bucket", "_at.guest", "_at.wrapped")
    dealt = with_fingerprint(spread.repartitionById(len(bounds), F.col("bucket")), "_text", "fingerprint")
    dealt = dealt.withColumn("_tie", F.xxhash64("_text"))
    in_order = W.partitionBy("bucket").orderBy("wrapped", "_ord", "_tie")
    out = dealt.withColumns({"next_text": F.lead("_text").over(in_order), "next_fingerprint": F.lead("fingerprint").over(in_order)})
    return out.filter("guest = 0").select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "fingerprint", "next_text", "next_fingerprint")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    docs = docs.withColumns({"n_chars": n.cast("long"), "edited": edited})
    docs = with_fingerprint(docs, "edited", "edited_fingerprint")
    docs = with_likeness(docs, "fingerprint", "edited_fingerprint", "near_edited")
    docs = with_likeness(docs, "fingerprint", "next_fingerprint", "near_next")
    docs = with_differences(docs, "fingerprint", "edited_fingerprint", "sections", "paragraphs")
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                       F.size("sections").cast("long").alias("n_differing_sections"), F.size("paragraphs").cast("long").alias("n_differing_paragraphs"))
