"""Parties, events and metadata of documents, and the graph updates they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docwright.functions.matches import spans
from docwright.functions.text import first_date, trimmed
from docwright.operators.graph import MONTHS, dated_days, event_kind, is_event, resolved, similar
from docwright.session import dropped, saved

MONTH = "|".join(MONTHS)
#: Words that make no party by themselves.
NOISE = (
    "justice", "honour", "lord", "lady", "judge", "master", "registrar", "recorder", "tribunal", "bench", "court", "chamber", "division", "ewhc",
    "ewca", "uksc", "ukut", "ewfc", "ukeat", "qbd", "chd", "tcc", "chancery", "queens", "kings", "admiralty", "commercial", "mercantile", "patents",
    "enterprise", "family", "crown", "county", "magistrates", "supreme", "appeal", "high", "claimant", "defendant", "applicant", "respondent",
    "appellant", "petitioner", "intervener", "plaintiff", "pursuer", "defender", "witness", "expert", "barrister", "solicitor", "counsel", "advocate",
    "cpr", "practice", "direction", "order", "judgment", "ruling", "hearing", "trial", "application", "claim", "action", "proceedings", "disclosure",
    "discovery", "pleading", "statement", "schedule", "bundle", "skeleton", "submission", "evidence", "exhibit", "particulars", "defence", "reply",
    "counterclaim", "rejoinder", "affidavit", "declaration", "certificate", "notice", "request", "january", "february", "march", "april", "may",
    "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "ltd", "plc",
    "llp", "inc", "corp", "para", "paras", "page", "pages", "section", "sections", "clause", "clauses", "annex", "annexe", "appendix", "part",
    "chapter", "article", "regulation", "the", "and", "for", "from", "with", "this", "that", "which", "where", "when", "what", "who", "how", "why",
    "between", "against", "before", "after", "during", "upon", "under", "over", "into", "onto", "about", "hmrc", "fca", "pra", "cma", "ofcom",
    "ofgem", "nhs", "dwp", "parliament", "government", "ministry", "department", "secretary", "minister", "majesty", "royal", "british", "english",
    "united", "kingdom", "england", "wales", "scotland", "ireland",
)
#: Patterns of companies (weight 2) and of companies with a role (weight 3, in any case, the name alone), and of judges.
COMPANIES = (
    r"\b([A-Z][a-z]*(?:\s+[A-Z][a-z]*){0,4})\s+(?:Limited|Ltd\.?)\b",
    r"\b([A-Z][a-z]*(?:\s+[A-Z][a-z]*){0,4})\s+(?:PLC|Plc|LLP|LP)\b",
    r"\b([A-Z][a-z]+)\s+(?:&|and)\s+Co\.?\b",
    r"\b([A-Z][a-z]*(?:\s+[A-Z][a-z]*){0,3})\s+(?:Corporation|Corp\.?|Inc\.?)\b",
)
ROLE = r"(?i)\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Limited|Ltd|PLC|LLP))\s*\(\s*(?:the\s+)?[\"']?(?:First|Second|Third|Fourth|Fifth)?\s*(?:Claimant|Defendant|Applicant|Respondent)[\"']?\s*\)"
JUDGES = (r"\b(?:Mr|Mrs|Lord|Lady|Dame|Sir)\s+Justice\s+[A-Z][a-z]+", r"\bJudge\s+[A-Z][a-z]+", r"\b(?:His|Her)\s+Honou?r\s+Judge\s+[A-Z][a-z]+")
#: What a party's name may not start with, hold, or be.
FIRST_WORDS = ("the", "a", "an", "or", "and", "any", "all", "no", "each", "every", "seeks", "alleges", "claims",
               "holdings", "investments", "properties", "services", "management", "realisations", "recoveries", "solicitors", "london")
FRAGMENTS = ("or ", "and ", " a ", " the ", " is ", " was ", " are ", " were ", " be ", " been ", " being ", " has ", " have ", " had ", " will ", " would ", " could ",
             " should ", " may ", " might ", " must ", " shall ", " can ", "justice", "judge", "honour", "incorporated", "thereafter", "including", "pursuant", "notwithstanding", "hereinafter", "aforementioned")
WHOLE = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "dame", "company", "corporation", "firm", "entity", "person", "individual", "party", "defendant", "claimant")
SUFFIXES = ("limited", "ltd", "plc", "llp", "inc", "corp")
ARTICLES = ("the ", "The ", "a ", "A ", "an ", "An ")
#: Kinds of documents whose text is taken for parties and dates, and the least score of a party.
AUTHORITATIVE = ("witness_statement", "pleading", "court_filing", "skeleton_argument", "expert_report")
LEAST_SCORE, FULL_SCORE = 6, 5.0
#: Patterns of metadata, tried in order on the first OPENING characters.
DATES = (r"\b(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})\b", rf"\b(\d{{1,2}}\s+(?:{MONTH})\s+\d{{4}})\b", rf"\b((?:{MONTH})\s+\d{{1,2}},?\s+\d{{4}})\b")
CASES = (r"\[(\d{4})\]\s*EWHC\s*(\d+)\s*\([A-Za-z]+\)", r"\b([A-Z]{2}\d{2}[A-Z]\d{5})\b", r"\b(CL[-\s]?\d{4}[-\s]?\d{4,6})\b", r"(?:Case|Claim)\s*(?:No|Number)[.:\s]*([A-Z0-9/-]+)")
PARTIES = (r"Between[:\s]*\n?\s*(.+?)\s*(?:Claimant|Applicant)", r"(.+?)\s+(?:v\.?|versus)\s+(.+?)(?:\n|$)")
AUTHORS = (r"(?:I,?\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+),?\s+(?:make this statement|say as follows)", r"Statement of[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"Witness[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)")
OPENING, EACH_PATTERN, SHOWN_DATES = 5000, 5, 5


def normalized_name(name: Column) -> Column:
    """Lower case, without punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""), r"\s+", " "))


def cleaned_name(name: Column) -> Column:
    """Single blanks, no punctuation at the ends, no article ahead of more than three letters."""
    out = F.btrim(F.trim(F.regexp_replace(name, r"\s+", " ")), F.lit(".,;:()[]\"'"))
    # A fold: a chain of conditions would name the text three times an article, and the plan would grow as their power.
    shorter = lambda t, a: F.when(F.startswith(t, a) & (F.length(t) > F.length(a) + 3), F.substring(t, F.length(a) + 1, F.length(t))).otherwise(t)
    out = F.aggregate(F.array(*map(F.lit, ARTICLES)), out, shorter)
    return F.trim(out)


def is_party(name: Column) -> Column:
    """Whether a name can be a party: no fragment of a sentence, no court, judge or bare title, at most five different words, and a capital or a company's suffix."""
    low = F.lower(name)
    words = F.array_distinct(F.split(F.trim(low), r"\s+"))
    noise = F.array(*map(F.lit, NOISE))
    holds = lambda parts: F.lit(False) if not parts else F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    bad = F.get(words, F.lit(0)).isin(*FIRST_WORDS) | holds(FRAGMENTS) | (F.size(words) > 5) | (F.size(F.array_except(words, noise)) == 0) | normalized_name(name).isin(*NOISE) | low.isin(*WHOLE)
    return (F.length(name) >= 3) & ~bad & (holds(SUFFIXES) | name.rlike("[A-Z][a-z]"))


def parties(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, normalized, kind, score, confidence): companies that a document names often enough.

    A mention weighs 2, one with a role 3; the longest spelling is shown, the first of these. A document's matches are arrays
    of its own row, counted by (id, normalized) with partial sums.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [(p, 0, "company", 2) for p in COMPANIES] + [(ROLE, 1, "litigant", 3)]

    def matched(n: int, pattern: str, group: int, kind: str, weight: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, i: F.struct(cleaned_name(m).alias("name"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.lit(n).alias("pattern"), i.alias("nth")))

    found = F.concat(*[matched(n, *e) for n, e in enumerate(every)])
    judges = F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in JUDGES]), normalized_name)
    rows = docs.select(F.col(id_col).alias("id"), judges.alias("judges"), F.explode(found).alias("m")).select("id", "judges", "m.*").withColumn("normalized", normalized_name(F.col("name")))
    rows = rows.filter(is_party(F.col("name")) & ~F.array_contains("judges", F.col("normalized")))
    first = F.struct(F.length("name").alias("n"), (-F.col("pattern")).alias("p"), (-F.col("nth")).alias("i"))
    got = rows.groupBy("id", "normalized").agg(F.max_by("name", first).alias("name"), F.min_by("kind", F.struct("pattern", "nth")).alias("kind"), F.sum("weight").alias("score"))
    return got.filter(F.col("score") >= LEAST_SCORE).select("id", "name", "normalized", "kind", "score", F.least(F.col("score") / FULL_SCORE, F.lit(1.0)).alias("confidence"))


def metadata(text: Column) -> dict[str, Column]:
    """document_date, dates_mentioned, case_number, parties and author of a text's opening; null where none is found."""
    opening = F.substring(F.coalesce(text, F.lit("")), 1, OPENING)
    group = lambda p, g: F.regexp_extract(opening, p, g)
    dates = F.concat(*[F.slice(F.regexp_extract_all(opening, F.lit(f"(?i){p}"), F.lit(1)), 1, EACH_PATTERN) for p in DATES])
    hit = lambda p: opening.rlike(p)
    case = F.when(hit(f"(?i){CASES[0]}"), F.concat(F.lit("["), group(f"(?i){CASES[0]}", 1), F.lit("] EWHC "), group(f"(?i){CASES[0]}", 2)))
    for p in CASES[1:]:
        case = case.when(hit(f"(?i){p}"), group(f"(?i){p}", 1))
    between, versus = (f"(?i){p}" for p in PARTIES)
    parties_ = F.when(hit(between), trimmed(group(between, 1))).when(hit(versus), F.concat(trimmed(group(versus, 1)), F.lit(" v "), trimmed(group(versus, 2))))
    author = F.coalesce(*[F.when(hit(p), trimmed(group(p, 1))) for p in AUTHORS])
    return {"document_date": F.get(dates, F.lit(0)), "dates_mentioned": F.when(F.size(dates) > 1, F.array_join(F.slice(dates, 1, SHOWN_DATES), ", ")),
            "case_number": case, "parties": parties_, "author": author}


def metadata_entities(docs: DataFrame, id_col: str, kind: str = "kind", meta: str = "metadata") -> DataFrame:
    """(id, type, name, role, confidence) from a document's metadata map: mail addresses, the author, the sides of "X v Y" and the case number."""
    value = lambda k: F.coalesce(F.try_element_at(F.col(meta), F.lit(k)), F.lit(""))
    one = lambda t, name, role, c: F.struct(F.lit(t).alias("type"), name.alias("name"), F.lit(role).alias("role"), F.lit(c).alias("confidence"))
    none = F.lit(None).cast("string")
    addresses = lambda k, r: F.transform(F.split(value(k), ","), lambda a: one("person", trimmed(a), r, 0.9))
    mail = [F.when(F.col(kind) == "email", addresses(k, r)) for k, r in (("from", "sender"), ("to", "recipient"), ("cc", "cc"))]
    sides = F.transform(F.split(value("parties"), r"(?i)\s+v\.?\s+"), lambda p, i: F.struct(F.lit("person").alias("type"), trimmed(p).alias("name"), F.when(i == 0, "claimant").otherwise("defendant").alias("role"), F.lit(0.85).alias("confidence")))
    versus = F.when(F.contains(F.lower(value("parties")), F.lit(" v ")), sides)
    single = F.array(one("person", value("author"), "author", 0.95), F.struct(F.lit("case_ref").alias("type"), value("case_number").alias("name"), none.alias("role"), F.lit(0.95).alias("confidence")))
    empty = F.slice(single, 1, 0)
    every = F.concat(*[F.coalesce(x, empty) for x in (*mail, versus, single)])
    return docs.select(F.col(id_col).alias("id"), F.explode(every).alias("e")).select("id", "e.*").filter("name <> ''")


def metadata_events(docs: DataFrame, id_col: str, file_name: str, meta: str = "metadata") -> DataFrame:
    """(id, day, date_text, description, kind): the filing of each document with a readable date."""
    text = F.try_element_at(F.col(meta), F.lit("document_date"))
    rows = docs.select(F.col(id_col).alias("id"), first_date(text).alias("day"), text.alias("date_text"), F.concat(F.lit("Document created: "), F.col(file_name)).alias("description"), F.lit("filing").alias("kind"))
    return rows.filter("day is not null")


def first_sentence(context: Column, least: int = 10, most: int = 200) -> Column:
    """The first sentence of more than `least` characters, cut to `most`; else the context's beginning."""
    some = F.filter(F.transform(F.split(context, "[.!?]"), trimmed), lambda s: F.length(s) > least)
    return F.substring(F.coalesce(F.get(some, F.lit(0)), context), 1, most)


def chunk_events(chunks: DataFrame, id_col: str, text_col: str, around: int = 100) -> DataFrame:
    """(id, day, date_text, kind, description): dates in words whose surroundings speak of an event; impossible days are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pattern = rf"(?i)\b(\d{{1,2}})\s*({MONTH})\s*(\d{{4}})\b"
    rows = chunks.select(F.col(id_col).alias("id"), text.alias("_text"), F.explode(spans(text, pattern)).alias("m"))
    start = F.greatest(F.col("m.start") - around, F.lit(0))
    context = F.substring(F.col("_text"), start + 1, F.col("m.start") + F.length("m.found") + around - start)
    part = lambda n: F.regexp_extract("m.found", pattern, n)
    month = F.array_position(F.array(*[F.lit(x.lower()) for x in MONTHS]), F.lower(part(2))).cast("string")
    day = F.to_date(F.try_to_timestamp(F.concat_ws("-", part(3), month, part(1)), F.lit("yyyy-M-d")))
    rows = rows.select("id", day.alias("day"), F.col("m.found").alias("date_text"), context.alias("_context")).filter(F.col("day").isNotNull() & is_event(F.col("_context")))
    return rows.select("id", "day", "date_text", event_kind(F.col("_context")).alias("kind"), first_sentence(F.col("_context")).alias("description"))


def node_key(prefix: str, *parts: Column) -> Column:
    """A node's id from what makes it, so that a repeated run makes the same ones."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def graph_update(docs: DataFrame, id_col: str, name_col: str, kind_col: str, text_col: str, least_mentions: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (document_id, node_id, label, node_type, metadata) and edges (document_id, source, target, relation, metadata) that documents propose.

    Every document is a node; of the authoritative kinds parties are mentioned in it and it references dates named often enough.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(name_col).alias("name"), F.coalesce(kind_col, F.lit("unknown")).alias("kind"), F.col(text_col).alias("text"))
    taken = rows.filter(F.col("kind").isin(*AUTHORITATIVE))
    p = parties(taken, "document_id", "text").withColumn("node_id", node_key("party", F.col("id"), F.col("normalized")))
    days = taken.select("document_id", F.explode(dated_days(F.coalesce("text", F.lit("")))).alias("day")).groupBy("document_id", "day").agg(F.count("*").alias("n")).filter(F.col("n") >= least_mentions)
    e = days.withColumn("node_id", node_key("event", F.col("document_id"), F.col("day")))
    label = F.coalesce(F.date_format(F.to_date(F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))), "dd MMMM yyyy"), F.col("day"))
    own = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    nodes = rows.select("document_id", F.col("document_id").alias("node_id"), F.col("name").alias("label"), F.lit("document").alias("node_type"), own(document_type=F.col("kind")).alias("metadata"))
    nodes = nodes.unionByName(p.select(F.col("id").alias("document_id"), "node_id", F.col("name").alias("label"), F.lit("party").alias("node_type"), own(entity_type=F.col("kind"), confidence=F.col("confidence")).alias("metadata")))
    nodes = nodes.unionByName(e.select("document_id", "node_id", label.alias("label"), F.lit("event").alias("node_type"), own(date=F.col("day"), mentions=F.col("n")).alias("metadata")))
    edges = p.select(F.col("id").alias("document_id"), F.col("node_id").alias("source"), F.col("id").alias("target"), F.lit("mentioned_in").alias("relation"), F.lit(None).cast("map<string,string>").alias("metadata"))
    edges = edges.unionByName(e.select("document_id", F.col("document_id").alias("source"), F.col("node_id").alias("target"), F.lit("references_date").alias("relation"), own(date=F.col("day")).alias("metadata")))
    return nodes, edges


def linked_or_created(mentions: DataFrame, entities: DataFrame, least: float = 0.85) -> DataFrame:
    """(type, name, entity_id, similarity, created): mentions (type, name) with the known entity they resolve to, or with a new one.

    New spellings are taken in the order of type and name, as a sequential loop would: one that resembles a spelling that made an
    entity before it joins the most similar of these (of equals the earlier), else it makes one. Rounds over the pairs of similar spellings decide: a
    spelling without an undecided or making one before it makes an entity, one with a making one before it joins; a
    round decides at least the first of every group. New ids follow the greatest known one in the same order.
    """
    known = saved(resolved(mentions, entities, least).withColumn("created", F.lit(False)), "linked")
    asked = mentions.select("type", F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()
    new = saved(asked.join(known.select("type", "name"), ["type", "name"], "left_anti"), "new-names")
    pairs = similar(new, new.select("type", F.lit(0).cast("long").alias("entity_id"), F.col("name").alias("other")), least, earlier=True)
    pairs = saved(pairs.select("type", "name", "other", "similarity"), "new-pairs")
    open_, edges, turns = new, pairs.select("type", "name", "other"), []
    while not open_.isEmpty():
        makers = open_.join(edges.hint("merge"), ["type", "name"], "left_anti")  # pairs are many more than their file's bytes tell: never through the driver
        joins = edges.join(makers.withColumnRenamed("name", "other"), ["type", "other"], "left_semi").select("type", "name").distinct()
        decided = saved(makers.withColumn("makes", F.lit(True)).unionByName(joins.withColumn("makes", F.lit(False))), "new-state")
        before, before_edges = open_, edges
        open_ = saved(open_.join(decided, ["type", "name"], "left_anti"), "new-open")
        edges = saved(edges.join(decided, ["type", "name"], "left_anti").join(decided.withColumnRenamed("name", "other"), ["type", "other"], "left_anti").select("type", "name", "other"), "new-edges")
        dropped(*(x for x in (before, before_edges) if x is not new))
        turns.append(decided)
        if len(turns) == 16:
            turns = [saved(reduce(DataFrame.unionByName, turns), "new-state")]
    state = reduce(DataFrame.unionByName, turns, new.limit(0).withColumn("makes", F.lit(True)))
    top = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0))).first()[0]
    makers = state.filter("makes").select("type", "name")
    by_type = makers.groupBy("type").agg(F.count("*").alias("_n"))
    ahead = by_type.select("type", (F.sum("_n").over(W.orderBy("type")) - F.col("_n")).alias("_before"))  # a row a type
    nth = F.row_number().over(W.partitionBy("type").orderBy("name"))
    made = saved(makers.withColumn("_nth", nth).join(F.broadcast(ahead), "type").select("type", "name", (F.col("_before") + F.col("_nth") + top).cast("long").alias("entity_id")), "new-entities")  # a row a type
    best = pairs.join(state.filter("not makes"), ["type", "name"], "left_semi").join(made.withColumnRenamed("name", "other"), ["type", "other"])
    best = best.groupBy("type", "name").agg(F.max(F.struct("similarity", (-F.col("entity_id")).alias("minus"))).alias("t"))
    joined = best.select("type", "name", (-F.col("t.minus")).alias("entity_id"), F.col("t.similarity").alias("similarity"), F.lit(False).alias("created"))
    return known.unionByName(made.select("type", "name", "entity_id", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("created"))).unionByName(joined)


def related(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (source, target, ...) by name joined to entity ids by name or alias in any case; those with an unknown end go."""
    names = entities.select("entity_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).groupBy(F.lower(F.trim("n")).alias("_n")).agg(F.min("entity_id").alias("_id"))
    for end in ("source", "target"):
        relations = relations.join(names, F.lower(F.trim(end)) == F.col("_n")).withColumn(f"{end}_id", F.col("_id")).drop("_n", "_id")
    return relations


def merged_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities (entity_id, name, aliases, metadata, source_chunks) after merges (old, new): the kept one takes the others' names, aliases and chunks, and their metadata where it
    has none of the key, the last id's first; a merge into itself does nothing."""
    m = mapping.filter("old <> new").select(F.col("old").alias("entity_id"), F.col("new").alias("_new"))
    rows = entities.join(m, "entity_id", "left").withColumn("_to", F.coalesce("_new", "entity_id")).withColumn("_own", F.col("_new").isNull())
    none = F.array().cast("array<string>")
    named = F.when(F.col("_own"), F.coalesce("aliases", none)).otherwise(F.array_union(F.array("name"), F.coalesce("aliases", none)))
    parts = F.sort_array(F.collect_list(F.struct((~F.col("_own")).alias("o"), F.col("entity_id").alias("i"), F.col("name").alias("name"), named.alias("a"), F.coalesce("source_chunks", none).alias("c"), F.map_entries("metadata").alias("m"))))
    got = rows.groupBy(F.col("_to").alias("entity_id")).agg(parts.alias("p"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform("p", lambda x: x[c])))
    pairs = F.flatten(F.filter(F.concat(F.slice(F.transform("p", lambda x: x["m"]), 1, 1), F.reverse(F.slice(F.transform("p", lambda x: x["m"]), F.lit(2), F.size("p")))), lambda m: m.isNotNull()))
    first = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda x: x["key"] == e["key"]))
    name = F.get("p", F.lit(0))["name"]
    return got.select("entity_id", name.alias("name"), F.array_remove(flat("a"), name).alias("aliases"), F.map_from_entries(first).alias("metadata"), flat("c").alias("source_chunks"))
