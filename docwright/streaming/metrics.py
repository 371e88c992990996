"""Streaming: append a metrics log, act on new rows only, count and order them by keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docwright.operators import segments
from docwright.operators.store import _fs

METRICS = "ts timestamp, model string, query_type string, tokens long, ms double, error string"


def read_metrics(spark: SparkSession, folder: str, schema: str = METRICS) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, once; the checkpoint makes the next call go on from here."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def when_enough(stream: DataFrame, act: Callable[[DataFrame, int], None], least: int, pending: str, checkpoint: str) -> StreamingQuery:
    """Call `act` with all rows not yet acted on once they are `least` or more, however they arrive.

    Each batch's rows go to the folder `pending` under the batch's number, so a repeated batch replaces itself. A batch that
    reaches the count acts on all that is there and then clears it; a job that dies in between acts on the same rows again.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{pending}/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(pending)
        n = rows.count()
        if n >= least:
            act(rows, number)
            fs, where = _fs(spark, pending)
            fs.delete(where, True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Counter(StatefulProcessor):
    """Rows of a group not yet told of; told when they are enough, or when the group was quiet for so long."""

    def __init__(self, least: int, quiet_ms: int | None):
        self.least, self.quiet_ms = least, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        seen = (self.count.get()[0] if self.count.exists() else 0) + sum(len(r) for r in rows)
        if seen >= self.least:
            self.count.clear()
            yield self._told(key, seen)
            return
        self.count.update((seen,))
        if self.quiet_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timer, expired) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            seen = self.count.get()[0]
            self.count.clear()
            yield self._told(key, seen)

    def _told(self, key, seen: int) -> pd.DataFrame:
        return pd.DataFrame({"group": [str(key[0])], "seen": [seen]})

    def close(self) -> None:
        pass


class _Released(StatefulProcessor):
    """Results of a group that came early wait for those before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long")
        self.early = handle.getMapState("early", "n long", "value string")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        due = self.next.get()[0] if self.next.exists() else 0
        for frame in rows:
            for n, value in zip(frame["number"].tolist(), frame["value"].tolist()):
                if n >= due:
                    self.early.updateValue((int(n),), (value,))
        out = []
        while self.early.containsKey((due,)):
            out.append((str(key[0]), due, self.early.getValue((due,))[0]))
            self.early.removeKey((due,))
            due += 1
        if out:
            self.next.update((due,))
            yield pd.DataFrame(out, columns=["group", "number", "value"])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, group: str, processor: StatefulProcessor, schema: str, timers: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(group).transformWithStateInPandas(processor, schema, "Append", timers)


def counted(stream: DataFrame, group: str, least: int, quiet_ms: int | None = None) -> DataFrame:
    """(group, seen): told once a group has `least` rows not yet told of, in whatever batches they came; fewer are told after quiet_ms without rows.

    The count is keyed state, so a restart from the checkpoint goes on counting.
    """
    return _stateful(stream.select(F.col(group).cast("string").alias("group")), "group", _Counter(least, quiet_ms), "group string, seen long", "None" if quiet_ms is None else "ProcessingTime")


def released(stream: DataFrame, group: str, number: str, value: str) -> DataFrame:
    """(group, number, value): rows released in order of number, from 0, none before those it follows; a repeated number counts once."""
    rows = stream.select(F.col(group).cast("string").alias("group"), F.col(number).cast("long").alias("number"), F.col(value).cast("string").alias("value"))
    return _stateful(rows.filter("number is not null"), "group", _Released(), "group string, number long, value string", "None")


def rollup(stream: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Extension: windowed counts and rates by model and query type, with a bound on late rows."""
    good = stream.filter(F.col("error").isNull()).withWatermark("ts", late)
    return good.groupBy(F.window("ts", width), "model", "query_type").agg(
        F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.avg(F.col("tokens") * 1000 / F.nullif(F.col("ms"), F.lit(0.0))).alias("avg_rate"))


def upsert_stream(stream: DataFrame, folder: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Upsert each batch into a table in segments by key, at the batch's own size; the last by the order column counts, in a batch and across batches."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            segments.write(batch.sparkSession, folder, batch, key, order)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_order(done: DataFrame, group: str, number: str) -> DataFrame:
    """Of results that came in any order those that may be released: numbers from 0 on without a gap before them."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(number)) - 1
    return done.withColumn("_n", nth).filter(F.col("_n") == F.col(number)).drop("_n")


def cancel(query: StreamingQuery) -> None:
    """Stop after the batch at work; the checkpoint lets a later start go on."""
    query.stop()
