"""The entity graph: lookups, context of a text, timelines, cascading deletes, dated events and fuzzy resolution."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from docwright.session import dropped, saved, shuffle_partitions

#: Words that make a context an event, and event kinds in the order they are tried.
EVENT_WORDS = ("meeting", "met", "agreed", "signed", "sent", "received", "discussed", "called", "attended", "filed", "submitted", "hearing", "trial", "conference", "deadline", "due")
EVENT_KINDS = (
    ("meeting", ("meeting", "met", "attended", "conference")),
    ("communication", ("email", "sent", "received", "wrote", "letter")),
    ("contract", ("signed", "contract", "agreement", "executed")),
    ("filing", ("filed", "submitted", "issued", "served")),
    ("hearing", ("hearing", "trial", "court")),
    ("deadline", ("deadline", "due", "expir")),
    ("transaction", ("paid", "transfer", "transaction", "payment")),
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _holds(text: Column, words) -> Column:
    return F.lower(text).rlike("|".join(words))


def find_entities(entities: DataFrame, part: str, kind: str | None = None, least: float = 0.0) -> DataFrame:
    """Entities (name, aliases, type, confidence) whose name or any alias holds `part`, in any case."""
    sought = F.lit(part.lower())
    named = F.contains(F.lower("name"), sought) | F.exists("aliases", lambda a: F.contains(F.lower(a), sought))
    found = entities.filter(named & (F.col("confidence") >= least))
    return found if kind is None else found.filter(F.col("type") == kind)


def relationships_of(edges: DataFrame, node=None, source: str = "source", target: str = "target", kind: str | None = None, type_col: str = "type") -> DataFrame:
    """Edges with the node at either end, of the type; None leaves either out."""
    found = edges if node is None else edges.filter((F.col(source) == node) | (F.col(target) == node))
    return found if kind is None else found.filter(F.col(type_col) == kind)


def timeline(events: DataFrame, day: str, first: str, last: str, keep_undated: bool = False) -> DataFrame:
    """Events whose day lies in the inclusive range."""
    within = F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return events.filter(within | F.col(day).isNull() if keep_undated else within)


def kind_counts(rows: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """(kind, n): a row for every kind that exists, zero included."""
    known = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counted = rows.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n"))
    return known.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def cascade(gone: DataFrame, key: str, tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> dict[str, DataFrame]:
    """Each table without the rows that name a deleted key in any of its columns."""
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    out = {}
    for name, (rows, columns) in tables.items():
        for c in columns:
            rows = rows.join(keys, F.col(c) == F.col("_gone"), "left_anti")
        out[name] = rows
    return out


def context(mentions: DataFrame, events: DataFrame, most_entities: int = 10, most_events: int = 5) -> DataFrame:
    """(text_id, entities, events): names of a text's entities, by name, and the labels of their first events by day.

    mentions (text_id, entity_id, name); events (event_id, entity_id, day, label). An event that several
    entities share counts once, by its first known day. An event among a text's first is among the first of the entity that gives it
    that day, so an entity's first `most_events` are all that its texts need.
    """
    named = mentions.select("text_id", "entity_id", "name").distinct()
    nth = F.row_number().over(W.partitionBy("text_id").orderBy("name", "entity_id"))
    some = named.withColumn("nth", nth).filter(F.col("nth") <= most_entities)
    when = F.struct(F.col("day").isNull().alias("undated"), "day", "event_id", "label")
    own = events.groupBy("entity_id", "event_id").agg(F.min(when).alias("e"))
    by_entity = W.partitionBy("entity_id").orderBy("e.undated", "e.day", "event_id")
    own = own.withColumn("_n", F.row_number().over(by_entity)).filter(F.col("_n") <= most_events)
    own = own.groupBy("entity_id").agg(F.sort_array(F.collect_list("e")).alias("first"))  # most_events of an entity
    got = some.join(own, "entity_id", "left").groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("nth", "name", "first"))).alias("m"))  # most_entities of a text
    got = got.withColumn("every", F.sort_array(F.flatten(F.filter(F.transform("m", lambda x: x["first"]), lambda x: x.isNotNull()))))
    told = F.filter("every", lambda e, i: ~F.exists(F.slice("every", F.lit(1), i), lambda x: x["event_id"].eqNullSafe(e["event_id"])))
    labels = F.transform(F.slice(told, 1, most_events), lambda e: e["label"])
    return got.select("text_id", F.transform("m", lambda x: x["name"]).alias("entities"), F.when(F.size(labels) > 0, labels).alias("events"))


def expanded(terms: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, terms): of (id, position, term) the first spelling of each term, in any case, in order."""
    first = terms.groupBy(id_col, F.lower("term").alias("low")).agg(F.min(F.struct("position", "term")).alias("t"))
    return first.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["term"]).alias("terms"))


def dated_days(text: Column) -> Column:
    """Days named in a text as yyyy-mm-dd strings; day and month are bounded, the calendar isn't checked."""
    month = "|".join(MONTHS)
    at = lambda p, n: F.regexp_extract_all(text, F.lit(p), F.lit(n))
    two = lambda x: F.lpad(x, 2, "0")
    named = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({month})\s+(\d{{4}})\b"
    numbers = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b"
    numeral = lambda m: two(F.array_position(F.array(*[F.lit(x.lower()) for x in MONTHS]), F.lower(m)).cast("string"))
    by_name = F.transform(F.arrays_zip(at(named, 1).alias("d"), at(named, 2).alias("m"), at(named, 3).alias("y")), lambda t: F.concat_ws("-", t["y"], numeral(t["m"]), two(t["d"])))
    zipped = F.filter(F.arrays_zip(at(numbers, 1).alias("d"), at(numbers, 2).alias("m"), at(numbers, 3).alias("y")), lambda t: (t["m"].cast("int") <= 12) & (t["d"].cast("int") <= 31))
    by_number = F.transform(zipped, lambda t: F.concat_ws("-", t["y"], two(t["m"]), two(t["d"])))
    return F.concat(by_name, by_number, at(r"\b\d{4}-\d{2}-\d{2}\b", 0))


def date_events(docs: DataFrame, id_col: str, text_col: str, least: int = 3) -> DataFrame:
    """(id, day, mentions): days that a document names at least `least` times."""
    rows = docs.select(F.col(id_col).alias("id"), F.explode(dated_days(F.coalesce(F.col(text_col), F.lit("")))).alias("day"))
    return rows.groupBy("id", "day").agg(F.count("*").alias("mentions")).filter(F.col("mentions") >= least)


def is_event(context: Column) -> Column:
    return _holds(context, EVENT_WORDS)


def event_kind(context: Column) -> Column:
    """The first kind whose words the context holds, else other."""
    return F.coalesce(*[F.when(_holds(context, words), F.lit(kind)) for kind, words in EVENT_KINDS], F.lit("other"))


def _rarest(names: DataFrame, text: str, freq: DataFrame, keep: Column) -> DataFrame:
    """names with rare: the first `keep` of its numbered letters, the rarest first; the order is the same for every name."""
    spelled = names.select("type", text).distinct()
    got = spelled.select("type", text, F.explode(_letters(F.col(text))).alias("letter")).join(freq, "letter")
    got = got.groupBy("type", text).agg(F.sort_array(F.collect_list(F.struct("many", "letter"))).alias("all"))
    return names.join(got.select("type", text, F.slice(F.transform("all", lambda x: x["letter"]), F.lit(1), keep).alias("rare")), ["type", text])


def _letters(text: Column) -> Column:
    """Each letter with the number of its occurrence, so that common elements of two names count their common letters."""
    every = F.split(text, "")
    return F.transform(every, lambda x, i: F.concat(x, F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def resolved(mentions: DataFrame, entities: DataFrame, least: float = 0.85) -> DataFrame:
    """(type, name, entity_id, similarity): for each distinct mention the most similar entity of its type, the smallest id on a tie.

    Similarity is the matching-blocks ratio. Equal names meet in a plain join. The rest are looked up at falling ratios: what is found at
    one is final, since all names that reach it are, and only names without any go on to the next, where more spellings meet.
    """
    asked = mentions.select("type", F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()
    known = entities.select("type", "entity_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("type", "entity_id", F.lower("n").alias("other"))
    known = saved(known.filter("entity_id is not null").groupBy("type", "other").agg(F.min("entity_id").alias("entity_id")), "known-names")
    out = asked.join(known, (asked["type"] == known["type"]) & (asked["name"] == known["other"])).select(asked["type"], "name", "entity_id", F.lit(1.0).alias("similarity"))
    left = saved(asked.join(out, ["type", "name"], "left_anti"), "unresolved")
    for part in TIERS:
        if left.isEmpty():
            break
        near = similar(left, known, least + (1 - least) * part)
        best = near.groupBy("type", "name").agg(F.max(F.struct("similarity", (-F.col("entity_id")).alias("minus"))).alias("t"))
        best = saved(best.select("type", "name", (-F.col("t.minus")).alias("entity_id"), F.col("t.similarity").alias("similarity")), "resolved")
        out, before = out.unionByName(best), left
        left = saved(left.join(best, ["type", "name"], "left_anti"), "unresolved")
        dropped(before)
    return out


#: Ratios tried by `resolved`, as parts of the way from the least one to 1.
TIERS = (0.8, 0.55, 0.3, 0.0)
#: Two names of so many subsequences or fewer, of the length that the ratio asks for, meet by these; longer ones by rare letters.
SUBSEQUENCES = 6000


def similar(asked: DataFrame, known: DataFrame, least: float, earlier: bool = False) -> DataFrame:
    """(type, name, entity_id, other, similarity): every pair of asked (type, name) and known (type, entity_id, other) that reaches the ratio; with `earlier`
    only those whose other spelling sorts before the name.

    Matching blocks are a common subsequence, so names of lengths l and m that reach the ratio share one of just least * (l + m) / 2
    letters: they meet by type and a subsequence of that length, of which a name has few as long as the ratio lets few letters go. Where
    it has too many they meet by letters: l * least / (2 - least) letters are common and as much of m, so one of these is
    among the rarest letters of both, as many as that leaves. Either way no pair that reaches the ratio is left out.
    """
    names = saved(asked.select("type", "name").distinct(), "names")
    spelled = saved(known.select("type", "other").filter("other <> ''").distinct(), "spellings")
    ratio = (2 - least) / least
    lengths = names.select("type", F.length("name").alias("l")).distinct().join(spelled.select("type", F.length("other").alias("m")).distinct(), "type")
    shapes = saved(_ways(lengths.filter((F.col("m") <= F.col("l") * ratio + 1e-9) & (F.col("l") <= F.col("m") * ratio + 1e-9)), least), "lengths")
    parts = shuffle_partitions(names.sparkSession)
    short, long_ = shapes.filter("few"), shapes.filter("not few")
    left = _subsequences(names, "name", short.select("type", F.col("l").alias("n"), "common"), parts)
    right = _subsequences(spelled, "other", short.select("type", F.col("m").alias("n"), "common"), parts)
    before = [F.col("other") < F.col("name")] if earlier else []
    # Spark takes exploded rows for as many as the names, and would broadcast them through the driver: they meet in a sort-merge join.
    pairs = left.join(right.hint("merge"), ["type", "key"])
    pairs = (pairs.filter(before[0]) if before else pairs).select("type", "name", "other")
    if not long_.isEmpty():
        far = _by_letters(names.join(long_.select("type", F.col("l").alias("_n")).distinct(), (names["type"] == long_["type"]) & (F.length("name") == F.col("_n")), "left_semi"),
                          spelled.join(long_.select("type", F.col("m").alias("_n")).distinct(), (spelled["type"] == long_["type"]) & (F.length("other") == F.col("_n")), "left_semi"), ratio)
        pairs = pairs.unionByName(far.filter(before[0]) if before else far)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for f in frames:
            m, scores = SequenceMatcher(None), []
            for a, b in zip(f["name"], f["other"]):
                m.set_seqs(a, b)
                scores.append(m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0)
            out = f.assign(similarity=scores)
            yield out[out["similarity"] >= least]

    # Pairs are small and their comparison is slow: a fixed number of tasks, not as many as their bytes need.
    found = pairs.distinct().repartition(parts).mapInPandas(run, "type string, name string, other string, similarity double")
    return found.join(known.filter("entity_id is not null").distinct(), ["type", "other"]).select("type", "name", "entity_id", "other", "similarity")


def _ways(lengths: DataFrame, least: float) -> DataFrame:
    """lengths (type, l, m) with the least common letters, and whether names of both lengths have few subsequences of so many; a row a type and two lengths."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            common = [max(0, math.ceil(least * (l + m) / 2 - 1e-9)) for l, m in zip(f["l"], f["m"])]
            yield f.assign(common=common, few=[math.comb(l, c) + math.comb(m, c) <= SUBSEQUENCES for l, m, c in zip(f["l"].tolist(), f["m"].tolist(), common)])

    return lengths.mapInPandas(run, "type string, l int, m int, common int, few boolean")


def _subsequences(names: DataFrame, text: str, wanted: DataFrame, parts: int) -> DataFrame:
    """(type, key, name): a hash of each subsequence of the wanted (type, n, common) lengths of a name of n letters."""
    wanted = wanted.groupBy("type", "n").agg(F.collect_set("common").alias("_common"))  # no more than lengths of names
    rows = names.withColumn("n", F.length(text)).join(wanted, ["type", "n"]).select("type", text, "_common").repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # so many names' subsequences at once
                some = batch.slice(k, 64)
                made = [{"".join(x) for c in common for x in combinations(t, c)} for t, common in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                at = pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array([y for x in made for y in x], pa.string())], names=["type", text, "_sub"])

    return rows.mapInArrow(run, f"type string, {text} string, _sub string").select("type", F.xxhash64("_sub").alias("key"), text)


def _by_letters(names: DataFrame, spelled: DataFrame, ratio: float) -> DataFrame:
    """(type, name, other) of names that share one of their rarest letters, within a length that the ratio allows; once a pair."""
    keep = lambda c: (F.length(c) - F.ceil(F.length(c) / ratio - 1e-9) + 1).cast("int")
    freq = spelled.select(F.explode(_letters(F.col("other"))).alias("letter")).union(names.select(F.explode(_letters(F.col("name"))))).groupBy("letter").agg(F.count("*").alias("many"))
    left = _rarest(names, "name", freq, keep("name"))
    left = left.select("type", "name", "rare", F.explode("rare").alias("b"), F.length("name").alias("l"))
    right = _rarest(spelled, "other", freq, keep("other"))
    right = right.select(F.col("type").alias("_t"), "other", F.col("rare").alias("_rare"), F.explode("rare").alias("_b"), F.length("other").alias("_l")).hint("merge")  # exploded, as above
    first = F.get(F.array_intersect("rare", "_rare"), F.lit(0))
    near_lengths = (F.col("_l") <= F.col("l") * ratio + 1e-9) & (F.col("l") <= F.col("_l") * ratio + 1e-9)
    return left.join(right, (F.col("type") == F.col("_t")) & (F.col("b") == F.col("_b")) & near_lengths & (first == F.col("b"))).select("type", "name", "other")
