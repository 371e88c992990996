import json

from docwright.operators import segments
from docwright.streaming import metrics


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def drain(df, out, checkpoint):
    df.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start(str(out)).awaitTermination()


def test_rows_are_counted_across_batches_and_restarts(spark, tmp_path):
    for number, n in enumerate([4, 6, 3, 12, 2]):
        put(tmp_path / "in", number, [{"g": "a"}] * n + [{"g": "b"}])
        stream = metrics.read_metrics(spark, str(tmp_path / "in"), "g string")
        drain(metrics.counted(stream, "g", 10), tmp_path / "out", tmp_path / "c")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 10), ("a", 15)]


def test_results_are_released_in_order(spark, tmp_path):
    for number, rows in enumerate([[("x", 1), ("y", 0)], [("x", 0), ("x", 3)], [("x", 2), ("x", 0), ("y", 2)]]):
        put(tmp_path / "in", number, [{"g": g, "n": n, "v": f"{g}{n}"} for g, n in rows])
        stream = metrics.read_metrics(spark, str(tmp_path / "in"), "g string, n long, v string")
        drain(metrics.released(stream, "g", "n", "v"), tmp_path / "out", tmp_path / "c")
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        want = {0: {("y", 0)}, 1: {("y", 0), ("x", 0), ("x", 1)}, 2: {("y", 0), ("x", 0), ("x", 1), ("x", 2), ("x", 3)}}[number]
        assert {(r["group"], r["number"]) for r in got} == want and len(got) == len(want)


def test_no_row_of_a_small_batch_is_lost(spark, tmp_path):
    seen = []
    for number, n in enumerate([4, 6, 12, 3]):
        put(tmp_path / "in", number, [{"k": number * 100 + i} for i in range(n)])
        metrics.when_enough(metrics.read_metrics(spark, str(tmp_path / "in"), "k int"), lambda b, i: seen.append(sorted(r["k"] for r in b.collect())), 10, str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    assert seen == [[0, 1, 2, 3, 100, 101, 102, 103, 104, 105], [200 + i for i in range(12)]]


def test_the_last_by_order_wins(spark, tmp_path):
    for number, rows in enumerate([[("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid")], [("a", 2, "late"), ("b", 1, "x")]]):
        put(tmp_path / "in", number, [{"k": k, "at": t, "v": v} for k, t, v in rows])
        metrics.upsert_stream(metrics.read_metrics(spark, str(tmp_path / "in"), "k string, at int, v string"), str(tmp_path / "t"), "k", str(tmp_path / "c"), "at").awaitTermination()
    assert sorted(map(tuple, segments.read(spark, str(tmp_path / "t")).collect())) == [("a", 3, "new"), ("b", 1, "x")]
