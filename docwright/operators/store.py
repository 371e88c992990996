"""Stored tables and indexes: versions published at once, upserts, deletes, queues, flags and copies.

A stored table is a folder of versions with a pointer to the current one. A writer makes a new version and
then moves the pointer, so readers never see half of it and a job that dies leaves the old one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from docwright.operators.tables import delete, update_fields, upsert


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, folder: str) -> list[int]:
    fs, where = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[3:]) for n in names if n.startswith("at-"))


def publish(df: DataFrame, folder: str, keep: int = 2, partition_by: tuple[str, ...] = (), compression: str = "snappy") -> None:
    """Make df the table's current version; the last `keep` versions stay for readers at work."""
    spark = df.sparkSession
    n = max(_versions(spark, folder), default=0) + 1
    df.write.partitionBy(*partition_by).parquet(f"{folder}/v-{n}", compression=compression)
    fs, pointer = _fs(spark, f"{folder}/at-{n}")
    fs.create(pointer, True).close()
    for old in _versions(spark, folder)[:-keep]:
        for path in (f"{folder}/at-{old}", f"{folder}/v-{old}"):
            fs.delete(_fs(spark, path)[1], True)


def current(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The current version; an empty table in partitions has no file that tells its schema."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/v-{_versions(spark, folder)[-1]}")


def exists(spark: SparkSession, folder: str) -> bool:
    return bool(_versions(spark, folder))


def reset(spark: SparkSession, folder: str) -> None:
    """Drop the table with all versions."""
    fs, where = _fs(spark, folder)
    fs.delete(where, True)


def compact(spark: SparkSession, folder: str, files: int) -> None:
    publish(current(spark, folder).repartition(files), folder)


def upsert_stored(spark: SparkSession, folder: str, new: DataFrame, key: str, order: str | None = None) -> None:
    """Insert or replace by key and write a new version; of rows of `new` with one key the last by the order column stays, then that of the greater row hash. The first call makes the table.

    Rewrites the table: `segments` writes an update's own size.
    """
    hashed = F.xxhash64(*[c for c, t in new.dtypes if "map" not in t])
    last = F.max_by(F.struct(*new.columns), F.struct(*([F.col(order).alias("o")] if order else []), hashed.alias("h")))
    new = new.groupBy(key).agg(last.alias("_row")).select("_row.*")
    publish(upsert(current(spark, folder), new, key) if exists(spark, folder) else new, folder)


def delete_stored(spark: SparkSession, folder: str, gone: DataFrame, key: str) -> int:
    """Delete by key; returns how many rows went."""
    rows = current(spark, folder)
    left = delete(rows, gone, key)
    n = rows.count() - left.count()
    publish(left, folder)
    return n


def queued(existing: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Updates with those of `new` as pending; a document's earlier pending update is replaced, an accepted one stays."""
    kept = existing.join(new.select(F.col(key).alias("_k")).distinct(), (F.col(key) == F.col("_k")) & (F.col("status") == "pending"), "left_anti")
    return kept.unionByName(new.withColumn("status", F.lit("pending")).select(*existing.columns))


def decided(existing: DataFrame, keys: list, accept: bool, key: str = "document_id") -> DataFrame:
    """Pending updates of these documents accepted, or gone."""
    mine = F.col(key).isin(*keys) & (F.col("status") == "pending")
    if accept:
        return existing.withColumn("status", F.when(mine, "accepted").otherwise(F.col("status")))
    return existing.filter(~F.coalesce(mine, F.lit(False)))


def pending(existing: DataFrame, name: str = "document_name") -> DataFrame:
    return existing.filter("status = 'pending'").orderBy(name)


def marked(rows: DataFrame, key: str, value, flag: str, at: str, now: Column) -> DataFrame:
    """The row of that key with its flag set and the time it was."""
    mine = F.col(key).eqNullSafe(F.lit(value))
    return rows.withColumns({flag: F.when(mine, True).otherwise(F.col(flag)), at: F.when(mine, now).otherwise(F.col(at))})


def repaired(catalog: DataFrame, *indexes: DataFrame, name: str = "file_name", flag: str = "indexed") -> DataFrame:
    """Catalog rows whose file is in any index are marked as indexed; others keep their flag."""
    files = indexes[0].select(name)
    for other in indexes[1:]:
        files = files.union(other.select(name))
    found = files.distinct().withColumn("_in", F.lit(True))
    return catalog.join(found, name, "left").withColumn(flag, F.coalesce("_in", flag, F.lit(False))).select(*catalog.columns)


def copy_matter(tables: dict[str, DataFrame], matter: str, folder: str, key: str = "matter_id") -> None:
    """Export one matter's rows of every table."""
    for name, rows in tables.items():
        rows.filter(F.col(key) == matter).write.mode("overwrite").parquet(f"{folder}/{name}")


def imported(spark: SparkSession, tables: dict[str, DataFrame], folder: str, matter: str, key: str = "matter_id") -> dict[str, DataFrame]:
    """Tables with an exported matter's rows under the given id, in place of what they had of it."""
    out = {}
    for name, rows in tables.items():
        new = spark.read.parquet(f"{folder}/{name}").withColumn(key, F.lit(matter))
        out[name] = rows.filter(~F.col(key).eqNullSafe(F.lit(matter))).unionByName(new)
    return out


def without_matter(tables: dict[str, DataFrame], matter: str, key: str = "matter_id") -> dict[str, DataFrame]:
    return {name: rows.filter(~F.col(key).eqNullSafe(F.lit(matter))) for name, rows in tables.items()}


def matter_stats(matters: DataFrame, key: str = "matter_id", **counted: DataFrame) -> DataFrame:
    """Matters with a count for each table given by name, 0 where it has none."""
    for name, rows in counted.items():
        matters = matters.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return matters


def unique_slugs(names: DataFrame, slug: Column, order: str, day: str) -> DataFrame:
    """names with `slug`-yyyymmdd; a repeated one gets -1, -2 and so on in order."""
    rows = names.withColumn("matter_id", F.concat(slug, F.lit("-"), F.date_format(F.lit(day).cast("date"), "yyyyMMdd")))
    nth = F.row_number().over(W.partitionBy("matter_id").orderBy(order)) - 1
    return rows.withColumn("_n", nth).withColumn("matter_id", F.when(F.col("_n") > 0, F.concat_ws("-", "matter_id", "_n")).otherwise(F.col("matter_id"))).drop("_n")


def as_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def since_last(rows: DataFrame, created: str, last: str | None) -> DataFrame:
    """Rows created after the last run's mark."""
    return rows if last is None else rows.filter(F.col(created) > F.lit(last))


def run_since(spark: SparkSession, rows: DataFrame, created: str, folder: str, act: Callable[[DataFrame], DataFrame], key: str) -> int:
    """Act on rows created since the mark stored in the folder, upsert what comes back by key, and store the new mark; returns the new rows' number."""
    last = current(spark, f"{folder}/mark").first()[0] if exists(spark, f"{folder}/mark") else None
    new = since_last(rows, created, last)
    n, mark = new.agg(F.count("*"), F.max(created)).first()
    if n:
        upsert_stored(spark, f"{folder}/made", act(new), key)
        publish(spark.createDataFrame([(str(mark),)], "mark string"), f"{folder}/mark")
    return n


def described(tables: dict[str, DataFrame], samples: int = 2) -> DataFrame:
    """(table, column, type, rows, samples): every column of every table with the table's row count and its first values as text."""
    out = []
    for name, rows in tables.items():
        spark, first = rows.sparkSession, rows.limit(samples).collect()
        n = rows.count()
        out += [(name, c, t, n, [None if r[c] is None else str(r[c]) for r in first]) for c, t in rows.dtypes]
    return spark.createDataFrame(out, "table string, column string, type string, rows long, samples array<string>")


def tail(lines: DataFrame, file: str, number: str, most: int) -> DataFrame:
    """Each file's last `most` lines by number, whatever gaps the numbers have; each partition passes on its own last ones only."""
    nth = F.row_number().over(W.partitionBy(file).orderBy(F.desc(number)))
    return lines.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def listed(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows in order, with has_more."""
    some = rows.orderBy(order).limit(most + 1).withColumn("_n", F.row_number().over(W.orderBy(order)))  # most + 1 rows
    return some.withColumn("has_more", F.max("_n").over(W.partitionBy()) > most).filter(F.col("_n") <= most).drop("_n")


def merged_fields(catalog: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows updated field by field, and new keys added."""
    return update_fields(catalog, new, key).unionByName(new.join(catalog.select(key), key, "left_anti"), allowMissingColumns=True).select(*catalog.columns)
