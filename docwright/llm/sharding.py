"""Sharding by sampled splitters: shards of near-equal bytes, equal texts side by side.

Records are ordered by (text hash, id). A size-weighted sample of those keys gives quantile
splitters for many more ranges than shards; ranges that turn out overfull get splitters from a
denser sample of their own (ids split one hot text). Running sums within a range and the ranges'
offsets give each record its exact byte position, and the position names the shard. The texts
are read once and never shuffled; only (id, size, crc, hash) rows move.

Defined cases: null text has size 1 and the crc of no bytes; a null id ranks first; repeated
rows are separate records; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from docwright.session import saved, shuffle_partitions, table

SAMPLE_PER_RANGE = 100
OVERFULL = 2.0
ROUNDS = 3
FIRST_ID = -(2**63)


def range_of(splitters: list[tuple[int, int]]):
    """A UDF that numbers the range of (hash, id): how many splitters are not above it."""
    hashes = np.array([s[0] for s in splitters], dtype=np.int64)
    ids = np.array([s[1] for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def ranged(h: pd.Series, i: pd.Series) -> pd.Series:
        h, i = h.to_numpy(np.int64), i.to_numpy(np.int64)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for at in np.unique(low[low < high]):
            rows = (low == at) & (high > low)
            end = high[rows][0]
            high[rows] = at + np.searchsorted(ids[at:end], i[rows], "right")
        return pd.Series(high.astype(np.int32))

    return ranged


def _sample(keys: DataFrame, total: int, rows: int, seed: int) -> list[tuple[int, int]]:
    """About `rows` keys, each drawn with a chance in proportion to its size."""
    uniform = F.expr(f"shiftrightunsigned(xxhash64(h, ord_id, {seed}), 11)") * F.lit(2.0**-53)
    drawn = keys.filter(uniform * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(rows)))
    return sorted((r[0], r[1]) for r in drawn.select("h", "ord_id").collect())


def _quantiles(drawn: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot); sizes of shards differ by about one record."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = saved(docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("ord_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ), "shard-keys")
    ranges = max(4 * shards, shuffle_partitions(spark))
    total = keys.agg(F.sum("size")).first()[0] or 0
    splitters = _quantiles(_sample(keys, total, ranges * SAMPLE_PER_RANGE, 0), ranges)
    for turn in range(1, ROUNDS + 1):
        ranged = keys.withColumn("r", range_of(splitters)("h", "ord_id"))
        loads = {x["r"]: x for x in ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        over = [r for r, x in loads.items() if x["bytes"] > OVERFULL * total / ranges and x["n"] > 1]
        if not over or turn == ROUNDS:
            break
        inside = ranged.filter(F.col("r").isin(over))
        heavy = sum(loads[r]["bytes"] for r in over)
        more = int(np.ceil(heavy * ranges / max(total, 1))) + len(over)
        fresh = _quantiles(_sample(inside, heavy, more * SAMPLE_PER_RANGE, turn), more)
        splitters = sorted({*splitters, *fresh})
    offsets, before, rows = [], 0, 0
    for r in sorted(loads):
        offsets.append((r, before, rows))
        before, rows = before + loads[r]["bytes"], rows + loads[r]["n"]
    starts = spark.createDataFrame(offsets or [(0, 0, 0)], "r int, bytes_before long, rows_before long")
    in_range = W.partitionBy("r").orderBy("h", "ord_id", "size")
    upto = in_range.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        ranged.repartitionById(len(splitters) + 1, F.col("r"))
        .withColumns({"upto": F.sum("size").over(upto), "nth": F.row_number().over(in_range)})
        .join(F.broadcast(starts), "r")  # one row a range
        .withColumn("mid2", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast((mid2 * {shards}) div {2 * max(total, 1)} as int)")))
        .withColumn("index", F.col("rows_before") + F.col("nth") - 1)
        .select("_id", "size", "text_crc32", "shard", "index")
    )
    placed = saved(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("index").alias("first_index"))
    return placed.join(F.broadcast(first), "shard").select(  # one row a shard
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("index") - F.col("first_index")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
