"""Stored tables that take updates at their own size: a base, small delta segments, tombstones, merge on read, compaction.

A write adds one segment of new rows, an erasure one of tombstones; neither touches what is there. Segments are numbered, and a manifest
lists them. A writer puts its segment down first and then makes the next manifest, which fails if another
writer has made it: so readers never see half a write and no write is lost silently.

Which row of a key counts: erased rows are those written before the key's last erasure. Of the others the one with the greatest value of
the order column counts, then the later segment, then the greater row hash; without an order column the later segment. So a late copy of an
old version does not undo a newer one. Null is a key like others. Only keys that deltas touch are regrouped on reading.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.operators.store import _fs

#: After so many deltas they are merged into one; the base stays as it is.
MOST_DELTAS = 16
KEPT = 2
INNER = ("_segment", "_erased")


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    fs, where = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[9:]) for n in names if n.startswith("manifest-"))


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """{number, key, order, next, base, deltas, written}; base and deltas are lists of {path, rows}."""
    known = _manifests(spark, folder)
    if not known:
        return None
    fs, where = _fs(spark, f"{folder}/manifest-{known[-1]}")
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": known[-1]}
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, before: dict | None, after: dict) -> None:
    number = (before["number"] if before else 0) + 1
    fs, where = _fs(spark, f"{folder}/manifest-{number}")
    out = fs.create(where, False)  # fails if another writer was first
    out.write(json.dumps({k: v for k, v in after.items() if k != "number"}).encode())
    out.close()


def _put(rows: DataFrame, folder: str) -> dict:
    path = f"{folder}/segment-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return {"path": path, "rows": rows.sparkSession.read.parquet(path).count()}


def _rank(rows: DataFrame, key: str, order: str | None):
    hashed = [c for c, t in rows.dtypes if "map" not in t and c not in INNER]
    return F.struct(*([F.col(order).alias("o")] if order else []), F.col("_segment").alias("s"), F.xxhash64(*hashed).alias("h"))


def _settled(rows: DataFrame, key: str, order: str | None, tombstones: bool) -> DataFrame:
    """Of each key the row that counts, and its last tombstone if asked for."""
    gone = rows.filter("_erased").groupBy(F.col(key).alias("_gone_key")).agg(F.max("_segment").alias("_gone_at"))
    left = rows.filter("not _erased").join(gone, F.col(key).eqNullSafe(F.col("_gone_key")), "left").filter("_gone_at is null or _segment > _gone_at").drop("_gone_key", "_gone_at")
    best = left.groupBy(key).agg(F.max_by(F.struct(*rows.columns), _rank(rows, key, order)).alias("_row")).select("_row.*")
    if not tombstones:
        return best
    marks = gone.select(*[F.col("_gone_key").alias(c) if c == key else F.col("_gone_at").alias(c) if c == "_segment" else F.lit(True).alias(c) if c == "_erased" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    return best.unionByName(marks)


def write(spark: SparkSession, folder: str, new: DataFrame, key: str, order: str | None = None, most_deltas: int = MOST_DELTAS) -> int:
    """Insert or replace by key; the first call makes the table, with its order column. Returns the segment's number."""
    m = manifest(spark, folder)
    if m:
        key, order = m["key"], m["order"]
    n = m["next"] if m else 1
    rows = _settled(new.withColumns({"_segment": F.lit(n).cast("long"), "_erased": F.lit(False)}), key, order, False)
    put = _put(rows, folder)
    after = m or {"key": key, "order": order, "base": [], "deltas": [], "written": 0}
    after = after | {"next": n + 1, "base": after["base"] or [put], "deltas": [*after["deltas"], put] if after["base"] else [], "written": after["written"] + put["rows"]}
    _commit(spark, folder, m, after)
    if len(after["deltas"]) > most_deltas:
        merge_deltas(spark, folder)
    return n


def erase(spark: SparkSession, folder: str, gone: DataFrame) -> int:
    """Tombstones for the keys in `gone`; returns the segment's number."""
    m = manifest(spark, folder)
    schema = spark.read.parquet(m["base"][0]["path"]).dtypes
    marks = gone.select(F.col(m["key"])).distinct()
    marks = marks.select(*[F.col(c).cast(t).alias(c) if c == m["key"] else F.lit(m["next"]).cast("long").alias(c) if c == "_segment" else F.lit(True).alias(c) if c == "_erased" else F.lit(None).cast(t).alias(c) for c, t in schema])
    put = _put(marks, folder)
    _commit(spark, folder, m, m | {"next": m["next"] + 1, "deltas": [*m["deltas"], put], "written": m["written"] + put["rows"]})
    return m["next"]


def _deltas(spark: SparkSession, m: dict) -> DataFrame | None:
    return spark.read.parquet(*[d["path"] for d in m["deltas"]]) if m["deltas"] else None


def read(spark: SparkSession, folder: str, inner: bool = False) -> DataFrame:
    """The rows that count; `inner` keeps the segment numbers."""
    m = manifest(spark, folder)
    base, delta = spark.read.parquet(*[b["path"] for b in m["base"]]), _deltas(spark, m)
    if delta is not None:
        touched = delta.select(F.col(m["key"]).alias("_touched")).distinct()
        on = F.col(m["key"]).eqNullSafe(F.col("_touched"))
        base = base.join(touched, on, "left_anti").unionByName(_settled(base.join(touched, on, "left_semi").unionByName(delta), m["key"], m["order"], False))
    return base.drop("_erased") if inner else base.drop(*INNER)


def touched(spark: SparkSession, folder: str) -> DataFrame | None:
    """(key, _segment) of the keys in deltas: the segment that counts, null for an erased key; None without deltas."""
    m = manifest(spark, folder)
    delta = _deltas(spark, m)
    if delta is None:
        return None
    keys = delta.select(F.col(m["key"]).alias("_touched")).distinct()
    on = F.col(m["key"]).eqNullSafe(F.col("_touched"))
    live = _settled(spark.read.parquet(*[b["path"] for b in m["base"]]).join(keys, on, "left_semi").unionByName(delta), m["key"], m["order"], False)
    return keys.join(live.select(F.col(m["key"]).alias("_live"), "_segment"), F.col("_touched").eqNullSafe(F.col("_live")), "left").select(F.col("_touched").alias(m["key"]), "_segment")


def merge_deltas(spark: SparkSession, folder: str) -> None:
    """Make one delta of all: costs what they hold, not what the base does."""
    m = manifest(spark, folder)
    if len(m["deltas"]) > 1:
        put = _put(_settled(_deltas(spark, m), m["key"], m["order"], True), folder)
        _commit(spark, folder, m, m | {"deltas": [put], "written": m["written"] + put["rows"]})


def compact(spark: SparkSession, folder: str, files: int | None = None) -> None:
    """Make a new base of the rows that count, and clear what only older manifests name."""
    m = manifest(spark, folder)
    rows = read(spark, folder, inner=True).withColumn("_erased", F.lit(False))
    put = _put(rows.coalesce(files) if files else rows, folder)
    _commit(spark, folder, m, m | {"base": [put], "deltas": [], "written": m["written"] + put["rows"]})
    clear(spark, folder)


def clear(spark: SparkSession, folder: str, kept: int = KEPT) -> None:
    """Delete manifests but the last ones, and segments that none of those names."""
    fs, where = _fs(spark, folder)
    used: set[str] = set()
    numbers = _manifests(spark, folder)
    for n in numbers[-kept:]:
        stream = fs.open(_fs(spark, f"{folder}/manifest-{n}")[1])
        m = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        used |= {s["path"].rsplit("/", 1)[1] for s in [*m["base"], *m["deltas"]]}
    for n in numbers[:-kept]:
        fs.delete(_fs(spark, f"{folder}/manifest-{n}")[1], True)
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if name.startswith("segment-") and name not in used:
            fs.delete(s.getPath(), True)
