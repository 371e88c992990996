"""Quality classifier by co-training two views of a document.

The text-content view is a logistic regression on hashed byte trigram frequencies; the
page-metadata view is one on source, language, size and number of lines, and reads no word. Both start from the same
labelled rows. In each round each view labels every other document of the corpus, and those it is
sure of, by margins that rows kept apart bear out, teach the other view. They reach it as sums: executors add up the features of confident
documents by label and cell (a hash of source and language), so the driver gets as much for any corpus, and
each cell's mean counts by its share of the confident documents. Sums are of whole numbers: reruns
agree. Each view is then calibrated (Platt) on labelled rows kept apart, and a logistic combination of the
calibrated logits, fitted there too, scores every document. A document is kept from the score on that all but LOSS of the good
rows kept apart reach, 0.5 at most.

Bound (a parameter): LABELLED rows to learn from. Everything else reads all rows and whole texts.

Defined cases: null text is empty and null source or language is a value of its own; without
labels, or with labels of one class only, both views are constant, the score is 0.5 and all are kept; an empty
table gives an empty result; other columns pass through `reject_low_quality` untouched, whatever their names; repeated rows are rows, scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.llm.labelled import held_out, labelled_sample, logistic, sigmoid
from docwright.session import own_name, shuffle_partitions, table

LABELLED, ROUNDS = 4000, 2
BUCKETS, NAMES, CELLS = 4096, 64, 8
#: A view is sure from the margin on where so many of the rows kept apart are of one label, and so few at least.
CONFIDENT, FEWEST = 0.98, 20
PSEUDO_MASS, LOSS = 0.5, 0.002
#: Features are summed in units of 1 / UNIT.
UNIT = 1 << 20
#: Powers of two of characters, and of characters a line, told apart; counts before the names.
SIZES = 24
COUNTS = 3 + 2 * SIZES


def trigrams(raw: np.ndarray) -> np.ndarray:
    """The bucket of each byte trigram."""
    b = raw.astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20)


def content(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(trigrams(raw), minlength=BUCKETS) if len(raw) > 2 else np.zeros(BUCKETS)
    return np.sqrt(counts.astype(np.float32) / max(1, len(raw) - 2))


def metadata(text: str, lang, source) -> np.ndarray:
    """Of a text only its size and number of lines: what it says is the other view's."""
    size, lines = len(text), text.count("\n") + 1
    out = np.zeros(COUNTS + 3 * NAMES, np.float32)
    out[:3] = np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10
    out[3 + min(SIZES - 1, size.bit_length())] = 0.3
    out[3 + SIZES + min(SIZES - 1, (size // lines).bit_length())] = 0.3
    for k, name in enumerate((f"s{source}", f"l{lang}", f"{source}|{lang}")):
        out[COUNTS + k * NAMES + zlib.crc32(name.encode("utf-8", "surrogatepass")) % NAMES] = 0.3
    return out


WIDTHS = (BUCKETS, COUNTS + 3 * NAMES)
SUMS = "view int, cell int, label int, totals binary"


def confident_sums(docs: DataFrame, fitted: list, learnt: set[int]) -> pd.DataFrame:
    """Of all documents but the learnt ones: for each view, cell and label that the other view is sure of, their number (place -1) and the sum of each feature."""
    told = docs.sparkSession.sparkContext.broadcast((fitted, learnt))  # two views' weights, LABELLED ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, second), seen = told.value
        sums = [np.zeros((CELLS, 2, n + 1), np.int64) for n in WIDTHS]
        for batch in batches:
            for id_, text, lang, source in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if id_ in seen:
                    continue
                x = content(text or ""), metadata(text or "", lang, source)
                cell = zlib.crc32(f"{source}|{lang}".encode("utf-8", "surrogatepass")) % CELLS
                for v, (w, b, low, high) in ((1, first), (0, second)):
                    margin = float((x[1 - v] @ w + b)[0])
                    if margin >= high or margin <= low:
                        row = sums[v][cell, int(margin >= high)]
                        row[:-1] += np.rint(x[v] * UNIT).astype(np.int64)
                        row[-1] += 1
        for v, s in enumerate(sums):
            cell, label = np.nonzero(s[:, :, -1])
            columns = [pa.array(c.astype(np.int32)) for c in (np.full(len(cell), v), cell, label)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s[c, y].tobytes() for c, y in zip(cell, label)], pa.binary())], names=["view", "cell", "label", "totals"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("totals").to_pylist())
        return group.slice(0, 1).select(["view", "cell", "label"]).append_column("totals", pa.array([total.tobytes()], pa.binary()))

    # A task's rows are packed sums, at most a row a view, cell and label; they are added by pieces first, so that no task reads a row of every other.
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(run, SUMS)
    pieces = rows.withColumn("piece", F.pmod(F.spark_partition_id(), F.lit(shuffle_partitions(docs.sparkSession))))
    some = pieces.groupBy("view", "cell", "label", "piece").applyInArrow(add, SUMS)
    found = some.groupBy("view", "cell", "label").applyInArrow(add, SUMS).collect()  # a row a view, cell and label at most
    out = []
    for r in found:
        total = np.frombuffer(bytes(r["totals"]), np.int64)
        out += [(r["view"], r["cell"], r["label"], -1 if k == len(total) - 1 else k, total[k]) for k in np.flatnonzero(total).tolist()]
    return pd.DataFrame(out, columns=["view", "cell", "label", "place", "total"])


def prototypes(sums: pd.DataFrame, view: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean features of each cell and label, the labels, and what each counts: PSEUDO_MASS of the labelled rows of its class, by number."""
    own = sums[sums["view"] == view].sort_values(["cell", "label", "place"])
    x, labels, many = [], [], []
    for (_, label), part in own.groupby(["cell", "label"]):
        n = int(part["total"].iloc[0])  # place -1
        row = np.zeros(WIDTHS[view], np.float32)
        row[part["place"].to_numpy()[1:]] = part["total"].to_numpy()[1:] / (n * UNIT)
        x.append(row)
        labels.append(float(label))
        many.append(float(n))
    x, labels, many = np.array(x, np.float32).reshape(-1, WIDTHS[view]), np.array(labels), np.array(many)
    for c in (0.0, 1.0):
        if (labels == c).any():
            many[labels == c] *= PSEUDO_MASS * (y == c).sum() / many[labels == c].sum()
    return x, labels, many


def sure(margins: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """The margins down to which, and from which on, CONFIDENT of the rows kept apart are of one label; FEWEST of them at least, else none."""
    order = np.argsort(margins, kind="stable")
    m, one = margins[order], z[order] == 1
    n = np.arange(1, len(m) + 1)
    low = np.flatnonzero((np.cumsum(~one) >= CONFIDENT * n) & (n >= FEWEST))
    high = np.flatnonzero((np.cumsum(one[::-1]) >= CONFIDENT * n) & (n >= FEWEST))
    lowest, highest = float(m[low[-1]]) if len(low) else -np.inf, float(m[::-1][high[-1]]) if len(high) else np.inf
    return (lowest, highest) if lowest < highest else (-np.inf, np.inf)


def train(labelled: pd.DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> tuple:
    """(weights, bias, slope, offset) of either view, the calibrated views' weights in the joint logit and its base, and the score from which documents are kept."""
    views = [lambda r: content(r.text), lambda r: metadata(r.text, r.lang, r.source)]
    matrix = lambda rows, v: np.array([views[v](r) for r in rows.itertuples(index=False)], np.float32).reshape(-1, WIDTHS[v])
    learn, apart = labelled[labelled["_part"] > 0], labelled[labelled["_part"] == 0]
    y, z = learn["_y"].to_numpy(float), apart["_y"].to_numpy(float)
    x = [matrix(learn, v) for v in (0, 1)]
    given = [(np.zeros((0, n), np.float32), np.zeros(0), np.zeros(0)) for n in WIDTHS]
    for turn in range(rounds + 1):
        fitted = []
        for v in (0, 1):
            more, labels, mass = given[v]
            fitted.append(logistic(np.concatenate([x[v], more]), np.concatenate([y, labels]), rate=0.5 if v == 0 else 0.1, mass=np.concatenate([np.ones(len(y)), mass])))
        if turn == rounds or not len(y) or y.min() == y.max():
            break
        told = [(w, b, *sure(matrix(apart, v) @ w + b, z)) for v, (w, b) in enumerate(fitted)]
        sums = confident_sums(docs, told, set(labelled["doc_id"].tolist()))
        given = [prototypes(sums, v, y) for v in (0, 1)]
    out, logits = [], np.zeros((len(z), 2))
    for v in (0, 1):
        w, b = fitted[v]
        margin = np.clip(matrix(apart, v) @ w + b, -30, 30)
        slope, offset = np.ones(1), np.zeros(1)
        if len(z) and z.min() < z.max():
            slope, offset = logistic(margin[:, None] / 10, z, steps=500)
            slope = np.maximum(slope, 0.1) / 10
        logits[:, v] = margin * slope + offset
        out.append((w, b, slope, offset))
    weights, base = np.full(2, 0.5), np.zeros(1)
    if len(z) and z.min() < z.max():
        weights, base = logistic(logits / 10, z, steps=500)
        weights = np.maximum(weights, 0) / 10
        weights = weights if weights.any() else np.full(2, 0.5)
    good = np.sort(sigmoid(logits[z == 1] @ weights + base))
    return out, (weights, base), min(0.5, float(good[int(LOSS * len(good))])) if len(good) else 0.5


def scores(docs: DataFrame, labels: DataFrame, keep: list[str], names: tuple[str, str, str, str], labelled: int = LABELLED) -> DataFrame:
    """The columns `keep` of docs and, called `names`, the content, metadata and joint score, each from 0 (junk) to 1, and whether the document is kept."""
    learn = labelled_sample(docs, labels, "quality", labelled, ["text", "lang", "source"])
    told = docs.sparkSession.sparkContext.broadcast(train(learn, docs))  # BUCKETS weights
    schema = docs.select(*keep).schema
    for c, t in zip(names, ("double", "double", "double", "boolean")):
        schema = schema.add(c, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, (weights, base), threshold = told.value
        for batch in batches:
            n = batch.num_columns - 3
            margins = np.zeros((2, batch.num_rows))
            for k, (text, lang, source) in enumerate(zip(*(batch.column(n + i).to_pylist() for i in range(3)))):
                margins[0, k] = content(text or "") @ views[0][0]
                margins[1, k] = metadata(text or "", lang, source) @ views[1][0]
            a, b = (np.clip(m + bias, -30, 30) * slope + offset for m, (_, bias, slope, offset) in zip(margins, views))
            joint = sigmoid(a * weights[0] + b * weights[1] + base)
            made = [pa.array(c) for c in (sigmoid(a).astype(float), sigmoid(b).astype(float), joint.astype(float), joint >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *names])

    rows = docs.select(*keep, *[F.col(c).alias(own_name(docs, f"_{c}_in")) for c in ("text", "lang", "source")])
    return rows.mapInArrow(run, schema)


def with_score(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """docs with the joint score in a column of that name."""
    rest = [own_name(docs, f"_{c}") for c in ("content", "metadata", "kept")]
    return scores(docs, labels, docs.columns, (rest[0], rest[1], name, rest[2])).select(*docs.columns, name)


def reject_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    names = tuple(own_name(docs, f"_{c}") for c in ("content", "metadata", "score", "kept"))
    return scores(docs, labels, docs.columns, names).filter(F.col(names[3])).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = scores(docs, table(spark, sf_dir, "labels"), ["doc_id"], ("content_score", "metadata_score", "score", "kept"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", F.col("kept").cast("int").alias("keep"))
