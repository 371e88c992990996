"""An inverted-file index of vectors: coarse cells, residual product codes, probes by cell, exact distances at the end.

Cells and codebooks are trained by k-means on a sample, drawn by a hash over all rows; every row is indexed. A row's cell is the nearest
centre; its code is, for each part of what is left of it, the nearest of that part's codewords. Rows are sorted by (cell, id) and cut
into ranges of both, so a search reads the files of the cells it probes, and a full cell is in many of them.

`search` reads only codes of a query's nearest cells, as many as held nearly all neighbours in the sample, keeps the best by their code's distance and takes exact distances of those. `exact=True` goes on: the
last one's distance bounds which cells can hold a nearer row (centre's distance less the cell's radius), and those are read in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from docwright.operators.retrieval import _blocks, _first, _found, _numbers, nearest
from docwright.operators.store import current, publish
from docwright.session import saved, shuffle_partitions

SAMPLE, PARTS, CODES, TURNS = 20_000, 16, 256, 8
SPREAD = 1 << 30
#: Recall of the built index on so many of its rows, of their first ten neighbours: below it cells and rows are added.
RECALL, TRIES, NEIGHBOURS = 0.96, 100, 10


@dataclass
class Quantiser:
    centres: np.ndarray  # (cells, size)
    books: np.ndarray  # (parts, codes, size / parts)
    probes: int = 16  # cells a query reads unless told otherwise
    rerank: int = 100  # rows by code whose exact distances it takes

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, size / parts), padded with zeros."""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def codes(self, left: np.ndarray) -> np.ndarray:
        rows = self.split(left)
        return np.stack([squares(rows[:, p], self.books[p]).argmin(1) for p in range(len(self.books))], 1).astype(np.uint8)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each x to each y."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres; one that no row is near stays where it was."""
    r = np.random.default_rng(seed)
    centres = x[r.permutation(len(x))[:k]].copy()
    for _ in range(TURNS):
        near = squares(x, centres).argmin(1)
        total, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def needed_probes(x: np.ndarray, centres: np.ndarray, target: float, top: int, tries: int, seed: int) -> int:
    """How many nearest cells hold the share `target` of the nearest rows of `tries` rows of the sample; in the whole they are nearer still."""
    own = np.random.default_rng(seed).permutation(len(x))[:tries]
    near = np.argsort(squares(x[own], x), 1)[:, : top + 1]
    order = np.argsort(squares(x[own], centres), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(own), 0), 1)
    cell = squares(x, centres).argmin(1)
    return int(np.quantile(np.take_along_axis(place, cell[near], 1), target)) + 1


def train(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, parts: int = PARTS, codes: int = CODES, seed: int = 7, target: float = 0.98) -> Quantiser | None:
    """A quantiser from a sample of the rows (id, embedding); about the root of their number of cells, probes for the share `target` of neighbours. None without rows."""
    rows = vectors.filter("embedding is not null")
    n = rows.count()
    if n > 2 * sample:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SPREAD)) < SPREAD * 2 * sample // n + 1)
    x = np.array([r[0] for r in rows.select("embedding").limit(sample).collect()], np.float64)  # `sample` rows
    if not len(x):
        return None
    centres = k_means(x, min(len(x), cells or min(4096, max(1, int(n**0.5)))), seed)
    left = x - centres[squares(x, centres).argmin(1)]
    width = -(-x.shape[1] // parts)
    parts = -(-x.shape[1] // width)
    left = np.pad(left, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    k = min(codes, len(x))
    return Quantiser(centres, np.stack([k_means(left[:, p], k, seed + p) for p in range(parts)]), needed_probes(x, centres, target, 10, 200, seed))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def build(vectors: DataFrame, folder: str, quantiser: Quantiser | None = None, **trained) -> None:
    """(Re)build the index of vectors (id, embedding); rows without an embedding are left out."""
    spark = vectors.sparkSession
    q = quantiser or train(vectors, **trained)
    rows = vectors.filter("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if q is None:
        q = Quantiser(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    told = spark.sparkContext.broadcast(q)  # cells and codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = told.value
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1))
                cell = squares(x, q.centres).argmin(1)
                left = x - q.centres[cell]
                made = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in q.codes(left)], pa.binary()), pa.array(np.sqrt((left**2).sum(1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["id", "embedding", "cell", "code", "off"])

    coded = rows.mapInArrow(run, "id long, embedding array<double>, cell int, code binary, off double")
    publish(coded.repartitionByRange(shuffle_partitions(spark), "cell", "id").sortWithinPartitions("cell", "id"), f"{folder}/rows")
    radius = np.zeros(len(q.centres))
    for r in current(spark, f"{folder}/rows").groupBy("cell").agg(F.max("off").alias("off")).collect():  # a row a cell
        radius[r["cell"]] = r["off"]
    _publish(spark, folder, q, radius)
    _widened(spark, folder, q, radius)


def _publish(spark: SparkSession, folder: str, q: Quantiser, radius: np.ndarray) -> None:
    cell = lambda a: (a.astype(np.float64).tobytes(), list(a.shape))
    publish(spark.createDataFrame([(*cell(q.centres), *cell(q.books), radius.tobytes(), q.probes, q.rerank)], "centres binary, centres_shape array<int>, books binary, books_shape array<int>, radius binary, probes int, rerank int"), f"{folder}/cells")


def _widened(spark: SparkSession, folder: str, q: Quantiser, radius: np.ndarray) -> None:
    """Add cells and rows to what a query reads until the index, whole as it is, gives RECALL of what the exact way gives for some of its rows."""
    rows = current(spark, f"{folder}/rows")
    n = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("id", F.lit("recall")), F.lit(SPREAD)) < SPREAD * 4 * TRIES // max(1, n) + 1).limit(TRIES)
    queries = saved(some.select(F.monotonically_increasing_id().alias("query_id"), "embedding"), "recall-queries")
    exact = nearest(rows.select("id", "embedding"), queries, NEIGHBOURS)
    last = {r["query_id"]: (r["d"], r["n"]) for r in exact.groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("n")).collect()}  # TRIES rows
    while last and (q.probes < len(q.centres) or q.rerank < n):
        found = search(spark, folder, queries, NEIGHBOURS).select("query_id", "distance").collect()  # TRIES * NEIGHBOURS rows
        if sum(r["distance"] <= last[r["query_id"]][0] for r in found) >= RECALL * sum(k for _, k in last.values()):
            break
        q.probes, q.rerank = min(len(q.centres), q.probes * 3 // 2 + 1), min(max(n, 1), q.rerank * 3)
        _publish(spark, folder, q, radius)


def load(spark: SparkSession, folder: str) -> tuple[Quantiser, np.ndarray]:
    r = current(spark, f"{folder}/cells").first()
    made = lambda raw, shape: np.frombuffer(bytes(raw), np.float64).reshape(shape)
    return Quantiser(made(r["centres"], r["centres_shape"]), made(r["books"], r["books_shape"]), r["probes"], r["rerank"]), np.frombuffer(bytes(r["radius"]), np.float64)


FOUND = "_query long, id long, distance double"


def _scan(rows: DataFrame, told, top: int) -> DataFrame:
    """The best `top` of each batch for every query that wants its cell: by codes, or by embeddings where rows have no code."""
    by_code = "code" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wants, q = told.value
        numbers = pa.array(range(len(queries)), pa.int64())
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            ids, known = _numbers(batch.column("id"))
            places, taken, values = [], [], []
            for cell in np.unique(cells):
                asked, here = wants.get(int(cell), ()), np.flatnonzero(cells == cell)
                if not len(asked):
                    continue
                if by_code:
                    code = np.frombuffer(b"".join(batch.column("code").take(pa.array(here)).to_pylist()), np.uint8).reshape(len(here), -1)
                    left = q.split(queries[asked] - q.centres[cell])
                else:
                    x = _vectors(batch.column("embedding").take(pa.array(here)))
                for k, n in enumerate(asked):
                    if by_code:
                        table = ((left[k][:, None, :] - q.books) ** 2).sum(2)
                        distance = np.sqrt(table[np.arange(code.shape[1]), code].sum(1))
                    else:
                        distance = np.sqrt(((x - queries[n]) ** 2).sum(1))
                    first = _first(distance, ids[here], known[here], top)
                    places.append(np.full(len(first), n))
                    taken.append(here[first])
                    values.append(distance[first])
            if places:
                yield _found(numbers, places, batch.column("id"), taken, values, ["_query", "id", "distance"])

    return rows.mapInArrow(run, FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    by = W.partitionBy("_query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def search(spark: SparkSession, folder: str, queries: DataFrame, top: int = 10, probes: int | None = None, rerank: int | None = None, exact: bool = False, most_queries: int = 2000) -> DataFrame:
    """(query_id, id, distance, score, rank) as `nearest` gives them: nearly all of its rows, or with `exact` all of them."""
    q, radius = load(spark, folder)
    probes, rerank = min(probes or q.probes, len(q.centres)), rerank or q.rerank
    rows = current(spark, f"{folder}/rows")
    out = spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    asked = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    for ids, x in _blocks(asked, most_queries):
        if x.shape[1] != q.centres.shape[1]:
            continue  # an index without rows
        away = np.sqrt(squares(x, q.centres))
        near = np.argpartition(away, probes - 1, 1)[:, :probes]
        wants: dict[int, list[int]] = {}
        for n, cells in enumerate(near):
            for c in cells.tolist():
                wants.setdefault(c, []).append(n)
        shared = lambda w: spark.sparkContext.broadcast((x, w, q))  # noqa: B023, E731
        some = _best(_scan(rows.filter(F.col("cell").isin(*wants)).select("id", "cell", "code"), shared(wants), rerank), rerank).select("_query", F.col("id").alias("_near"))
        block = F.broadcast(spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "_query long, _asked array<double>"))  # most_queries rows
        full = rows.select("id", "embedding").join(some, F.col("id").eqNullSafe(F.col("_near"))).join(block, "_query")
        exactly = F.sqrt(F.aggregate(F.zip_with("embedding", "_asked", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        found = full.select("_query", "id", exactly.alias("distance"))
        if exact:
            bound = np.full(len(x), np.inf)
            held = _best(found, top).groupBy("_query").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
            for r in held.collect():  # a row a query of the block
                if r["n"] >= top:
                    bound[r["_query"]] = r["d"]
            wants = {}
            for n, c in zip(*np.nonzero(away - radius <= bound[:, None] + 1e-6)):
                wants.setdefault(int(c), []).append(int(n))
            found = _scan(rows.filter(F.col("cell").isin(*wants)).select("id", "cell", "embedding"), shared(wants), top)
        named = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "_query long, query_id long"))  # most_queries rows
        best = _best(found.withColumn("distance", F.round("distance", 6)), top).join(named, "_query")
        out = out.unionByName(saved(best.select("query_id", "id", "distance", "rank"), "neighbours"))
    return out.withColumn("score", F.round(1 / (1 + F.col("distance")), 6)).select("query_id", "id", "distance", "score", "rank")
