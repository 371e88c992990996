"""What queries shuffle and write, and how often they go round, on inputs where that once grew faster than the input."""

from pyspark.sql import functions as F

from docwright.operators import answers, blocks, citations, cooccurrence, graph, parties, positions


def shuffled(spark, act) -> tuple[int, int]:
    """Rows that the stages of act() shuffle, and its longest stage's number of tasks."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s for s in map(found.apply, range(found.size()))}

    before = stages()
    act()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    own = [s for k, s in stages().items() if k not in before]
    return sum(s.shuffleWriteRecords() for s in own), max(s.numTasks() for s in own)


def test_names_of_one_beginning_are_not_all_compared(spark):
    known = spark.range(3000).select(F.lit("org").alias("type"), F.col("id").alias("entity_id"), F.format_string("supplier#%09d", "id").alias("name"), F.array().cast("array<string>").alias("aliases"))
    asked = known.select("type", F.concat("name", F.lit("x")).alias("name"))
    n, _ = shuffled(spark, lambda: graph.resolved(asked, known).collect())
    assert n < 60 * 3000


def test_names_meet_in_as_many_tasks_as_there_are_partitions(spark):
    names = spark.range(50).select(F.lit("org").alias("type"), F.format_string("quite other %03d", "id").alias("name"))
    known = names.select("type", F.lit(1).cast("long").alias("entity_id"), F.col("name").alias("other"))
    assert shuffled(spark, lambda: graph.similar(names, known, 0.9).collect())[1] >= 4


def test_new_names_join_without_waiting(spark):
    """A name joins as soon as one that makes an entity is before it; of a chain each name but the first waited for the one before."""
    rows = [("org", f"name of a thing {'abcdefghijklmnopqrstuvwxyz'[k]}") for k in range(26)]
    none = spark.createDataFrame([], "entity_id long, type string, name string, aliases array<string>")
    saved, turns = parties.saved, []
    parties.saved = lambda df, name: turns.append(name) or saved(df, name)
    try:
        got = parties.linked_or_created(spark.createDataFrame(rows, "type string, name string"), none).collect()
    finally:
        parties.saved = saved
    assert {r["entity_id"] for r in got} == {1} and turns.count("new-open") == 1


def broadcast_joins(df) -> list[str]:
    """The keys of a plan's broadcast joins."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line]


def test_exploded_names_and_pairs_are_not_broadcast(spark, tmp_path):
    """They are many times the names whose size Spark knows, and went through the driver."""
    spark.range(400).select(F.lit("org").alias("type"), F.format_string("quite other %05d", "id").alias("name")).write.parquet(f"{tmp_path}/n")
    names = spark.read.parquet(f"{tmp_path}/n")
    known = names.select("type", F.lit(1).cast("long").alias("entity_id"), F.col("name").alias("other"))
    short = graph.similar(names, known, 0.85)
    assert not [x for x in broadcast_joins(short) if "key#" in x] and short.count() > 400
    more = lambda c: F.concat(F.lit("quite another and very much longer "), c)
    far = graph.similar(names.withColumn("name", more("name")), known.withColumn("other", more("other")), 0.85)
    assert not [x for x in broadcast_joins(far) if ", b#" in x and "_b#" in x] and far.count() > 400
    saved, kept = parties.saved, []
    parties.saved = lambda df, name: kept.append((name, df)) or saved(df, name)
    try:
        none = spark.createDataFrame([], "entity_id long, type string, name string, aliases array<string>")
        got = parties.linked_or_created(names, none)
        assert got.count() == 400
    finally:
        parties.saved = saved
    rounds = [df for name, df in kept if name == "new-state"]
    assert rounds and not [x for df in rounds for x in broadcast_joins(df) if "LeftAnti" in x]


def test_pairs_that_hardly_meet_cost_no_look_into_all_chunks(spark):
    rows = spark.range(4000).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("c", (F.xxhash64("c", "k") % 60).alias("e")).localCheckpoint()
    n, _ = shuffled(spark, lambda: cooccurrence.cooccurring(rows, "c", "e", 100, 0.5).collect())
    assert n < 12 * rows.count()


def test_heavy_and_light_chunks_count_together(spark):
    made = [(c, e) for c in range(30) for e in (1, 2)] + [(100 + c, e) for c in range(5) for e in range(50)]
    got = {(r["a"], r["b"]): r["together"] for r in cooccurrence.cooccurring(spark.createDataFrame(made, "c long, e long"), "c", "e", 5).collect()}
    assert got[1, 2] == 35 and got[1, 3] == got[40, 49] == 5 and len(got) == 50 * 49 // 2


def test_a_texts_events_come_from_the_first_of_each_entity(spark):
    events = spark.range(20000).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("entity_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7919 % 20000).cast("int")).alias("day"), F.col("id").cast("string").alias("label"))
    mentions = spark.range(400).select(F.col("id").alias("text_id"), (F.col("id") % 4).alias("entity_id"), F.lit("n").alias("name"))
    got = []
    n, _ = shuffled(spark, lambda: got.extend(graph.context(mentions, events).collect()))
    first = sorted((k for k in range(20000) if k % 4 == 1), key=lambda k: k * 7919 % 20000)[:5]
    assert n < 50000 and {tuple(r["events"]) for r in got if r["text_id"] % 4 == 1} == {tuple(map(str, first))}


def test_an_event_of_two_entities_counts_once_by_its_first_day(spark):
    events = spark.sql("SELECT * FROM VALUES (1L, 1L, DATE'2020-02-02', 'late'), (1L, 2L, DATE'2020-01-01', 'early'), (2L, 1L, DATE'2020-01-15', 'b'), (3L, 2L, NULL, 'c') AS t(event_id, entity_id, day, label)")
    mentions = spark.createDataFrame([(7, 1, "x"), (7, 2, "y"), (8, 9, "z")], "text_id long, entity_id long, name string")
    got = {r["text_id"]: (r["entities"], r["events"]) for r in graph.context(mentions, events).collect()}
    assert got == {7: (["x", "y"], ["early", "b", "c"]), 8: (["z"], None)}


def test_postings_are_shuffled_and_not_words(spark, tmp_path):
    docs = spark.range(50).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: F.concat(F.lit("w"), (x % 20).cast("string"))), " ").alias("t"))
    n, _ = shuffled(spark, lambda: positions.write(spark, str(tmp_path), docs, "id", ["t"]))
    assert n < 50 * 20 * 3 and positions.match(spark, str(tmp_path), '"w1 w2"').first()["hits"] == [100]


def test_heads_are_grouped_once_for_all_queries(spark, tmp_path):
    docs = spark.range(400).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * (k + 3) % 5).cast("string")) for k in range(8)]).alias("t"))
    blocks.build(docs, "id", ["t"], str(tmp_path))
    asked = docs.limit(60).select(F.col("id").alias("query_id"), F.col("t").alias("text"))
    got = []
    n, _ = shuffled(spark, lambda: got.extend(blocks.search(spark, str(tmp_path), asked, 5).collect()))
    held = blocks.pruned(spark, str(tmp_path), asked, 5)[0].count()
    assert len(got) == 300 and n < held / 2


def test_an_index_is_built_without_a_shuffle_of_words_or_postings(spark, tmp_path):
    docs = spark.range(400).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * (k + 3) % 5).cast("string")) for k in range(8)]).alias("t"))
    n, _ = shuffled(spark, lambda: blocks.build(docs, "id", ["t"], str(tmp_path)))
    held = blocks._blocks(spark, str(tmp_path))
    assert held.agg(F.sum("n")).first()[0] == 400 * 8
    assert n < 400 and n < held.count() / 4


def test_a_response_is_verified_without_a_row_a_sentence(spark):
    rows = spark.range(20).select("id", F.repeat(F.lit("This is bare. Here [Source: a | Page 1]. "), 200).alias("t"))
    chunks = spark.createDataFrame([("a", 1, None, "c", 0.9, 1)], "file_name string, page_number int, paragraph_number int, chunk_id string, score double, position int")
    got = []
    n, _ = shuffled(spark, lambda: got.extend(citations.verify(rows, "id", "t", chunks).collect()))
    assert {(r["n_citations"], r["n_missing"]) for r in got} == {(200, 0)}
    assert n < 2 * 20 * 200 + 200


def test_sentences_end_where_the_built_in_functions_end_them(spark):
    for text, want in (("One two. ", ["One two."]), ("One two. \n", ["One two."]), ("One two.\u0085x", []), ("Wait! No?\r\n", ["Wait!"])):
        got = [r["sentence"] for r in answers.uncited_sentences(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()]
        assert got == want


def test_citations_meet_chunks_in_tasks_of_one_size(spark, monkeypatch):
    """More citations are more tasks, not larger ones; nulls in a place count as before, and one place may have most citations."""
    from docwright import session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    places = [("a", 1, None), ("a", 1, 2), ("a", None, None), ("b", 3, None), ("b", 3, None), (None, 1, None), (None, None, None)]
    chunks = spark.createDataFrame(places, "file_name string, page_number int, paragraph_number int")
    asked = [("a", 1, None), ("a", 1, 3), ("a", None, None), (None, 1, None), ("b", 3, None), ("c", 3, None), ("b", None, 3)]
    rows = [(i % 90, *(asked[i % 7] if i < 400 else asked[0])) for i in range(1400)]
    found = spark.createDataFrame(rows, "id long, file_name string, page_number int, paragraph_number int")
    known = {p for p in places if p[0] is not None}
    want = {}
    for i, *place in rows:
        n, lost = want.get(i, (0, 0))
        want[i] = n + 1, lost + (tuple(place) not in known)
    for told in (None, 1407):
        out = citations.verified(found, chunks, told)
        assert out.rdd.getNumPartitions() >= 1400 // 50
        assert sorted(map(tuple, out.collect())) == sorted((i, n, lost, lost == 0) for i, (n, lost) in want.items())
    one = citations.placed(found, chunks.distinct().withColumn("chunk_id", F.concat_ws("|", F.lit("c"), "file_name", "page_number", "paragraph_number")))
    assert one.columns == [*found.columns, "chunk_id"] and one.count() == 1400
    assert all((r["chunk_id"] is None) == ((r["file_name"], r["page_number"], r["paragraph_number"]) not in known) for r in one.collect())
