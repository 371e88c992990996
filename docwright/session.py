"""Session and table helpers shared by every module."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key with this share of a task's rows is hot.
HOT_SHARE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, any Hadoop-readable path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in spark.checkpoint.dir. Only a local master without that setting
    (tests on one machine) gets a temporary folder; anywhere else its absence is an error,
    since executors don't see the driver's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docwright-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """One folder an application, so that what a dead driver left behind is found by its id."""
    return f"{shared_dir(spark)}/docwright-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and reread: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    folder = _own_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete saved tables that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_saved_at", None)
        if path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its owner clears the shared folder
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: So many rows go to a task where rows are dealt by a key to tasks of one size.
TASK_ROWS = 250_000


def task_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of some TASK_ROWS for so many rows, and as many as run at once at least: more rows are more tasks, not larger ones."""
    return max(min(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)), -(-rows // TASK_ROWS))


#: Rows and bytes of an Arrow batch of texts: a task holds one batch in the JVM and one in its Python worker, besides what is made of them.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_ROWS and some BATCH_BYTES at most, where the session doesn't set its own."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def own_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined to lookup, which has one row a key, so that no key's rows need one task.

    A key is hot with 1 / HOT_SHARE of an even task's rows or more. Its rows are dealt to pieces of that
    size by a hash of their other columns, and its row of lookup is repeated once a piece. There are at most
    HOT_SHARE times the partitions of hot keys: so many narrow rows (key, pieces) reach the driver and
    are broadcast. `rows` is read twice and should be saved; counts (key, _many) spares the first
    read. `how` is inner or left.
    """
    spark = rows.sparkSession
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("_many"))
    total = counts.agg(F.coalesce(F.sum("_many"), F.lit(0))).first()[0]
    least = max(1000, total // (shuffle_partitions(spark) * HOT_SHARE))
    pieces = counts.filter((F.col("_many") >= least) & F.col(key).isNotNull()).select(key, F.ceil(F.col("_many") / least).cast("int").alias("_pieces"))
    found = pieces.collect()
    if not found:
        return rows.join(lookup, key, how)
    hot = F.broadcast(spark.createDataFrame(found, pieces.schema))
    others = [c for c, t in rows.dtypes if c != key and not t.startswith("map")]
    dealt = rows.join(hot, key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_pieces")).cast("int"), F.lit(0))).drop("_pieces")
    copies = lookup.join(hot, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(copies, [key, "_piece"], how).drop("_piece")
