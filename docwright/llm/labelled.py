"""Bounded samples of labelled documents and the numpy pieces that the classifiers share."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

HELD_OUT_FOLD = 2
FOLDS = 4
#: A labelled row with a longer text is not learnt from (it is scored like any other).
LONGEST = 100_000
SPREAD = 1 << 30


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(FOLDS))


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return fold(id_) == HELD_OUT_FOLD


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, columns: list[str]) -> pd.DataFrame:
    """At most `most` labelled rows of the learning folds, in the order of a hash of the id, with their whole texts.

    Labels other than 0 and 1, null ones and those of null ids are left out; of conflicting labels of an id the larger counts.
    Where there are more labels than `most`, a hash leaves about as many before they are sorted, so that partitions
    send the driver what it keeps and not `most` rows each.
    """
    some = labels.select("doc_id", F.col(label).cast("int").alias("_y")).filter(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = some.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("_y").alias("_y"))
    known = some.count()
    if known > 2 * most:
        some = some.filter(F.pmod(F.xxhash64("_label_id", F.lit("sample")), F.lit(SPREAD)) < SPREAD * 2 * most // known + 1)
    some = some.orderBy(F.xxhash64("_label_id"), "_label_id").limit(most)
    # One row an id, that of the smallest text hash, and texts of LONGEST characters at most: so `most` rows of bounded size.
    texts = docs.select("doc_id", *columns).filter(F.length(F.coalesce("text", F.lit(""))) <= LONGEST)
    met = texts.join(F.broadcast(some), texts["doc_id"] == some["_label_id"])
    one = met.groupBy("_label_id", "_y").agg(F.min_by(F.struct("doc_id", *columns), F.xxhash64(*columns)).alias("_row"))
    got = one.select("_row.doc_id", "_y", *[f"_row.{c}" for c in columns]).toPandas()
    got["text"] = got["text"].fillna("")
    got["_part"] = [zlib.crc32(f"part{i}".encode()) % 5 for i in got["doc_id"]]
    return got.sort_values(["doc_id", "text"]).reset_index(drop=True)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.05, mass: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a logistic regression of rows that count by `mass`; classes count alike. One class alone teaches nothing: all zero."""
    x = np.ascontiguousarray(x, np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.zeros(1, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return w, b
    mass = np.ones(len(y)) if mass is None else mass
    weight = mass * np.where(y == 1, 0.5 / mass[y == 1].sum(), 0.5 / mass[y == 0].sum())
    adam = Adam([w, b], rate)
    for _ in range(steps):
        g = ((sigmoid(x @ w + b) - y) * weight).astype(np.float32)
        adam.step([x.T @ g + l2 * w, np.array([g.sum()])])
    return w, b
