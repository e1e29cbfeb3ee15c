"""Bounded labelled samples, and small numpy models fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on at most.  Where
#: texts come to the driver, they come whole, and only so many rows of the sample
#: (in the order of a hash) as have this many characters together.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 24_000_000


def remainder(of: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(of.cast("string").cast("binary")), F.lit(modulus))


def held_out(modulus: int, kept_out: int) -> Column:
    """Whether a row's labels must not be learnt from (null ids: never learnt)."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == kept_out, F.lit(False))


def picked_labels(labels: DataFrame, label: str, modulus: int, kept_out: int, rows: int = SAMPLE_ROWS):
    """doc_id and y of the rows to learn from (None: there are none), picked from
    the label table alone, and the number of usable rows of each class."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(modulus, kept_out))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in sorted(counts):
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    return picked and picked.distinct(), counts


def class_weights(y: np.ndarray, counts: dict) -> np.ndarray:
    """Weights that restore the share of each class among all usable rows."""
    weight = np.ones(len(y))
    total = sum(counts.values())
    for c, n in counts.items():
        share = (y == c).mean() if len(y) else 0
        if share:
            weight[y == c] = n / total / share
    return weight


def within(sample: DataFrame, chars: int, *by: str) -> DataFrame:
    """The first rows of a bounded sample, for each value of ``by``, whose texts
    have at most ``chars`` characters together; the first of all in any case."""
    order = W.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    total = F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return sample.withColumns({"_total": total, "_turn": F.row_number().over(order)}).where((F.col("_total") <= chars) | (F.col("_turn") == 1)).drop("_total", "_turn")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, kept_out: int, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS):
    """Whole texts, labels and weights.  The few picked ids are broadcast, so no
    text is shuffled but those of the sample."""
    picked, counts = picked_labels(labels, label, modulus, kept_out, rows)
    if picked is None:
        return [], np.zeros(0), np.zeros(0)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    got = within(found.select("doc_id", "y", "text").limit(4 * rows), chars).orderBy("doc_id", "y", "text").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    return got.column("text").to_pylist(), y, class_weights(y, counts)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of texts, as ``_seq`` takes them."""
    data = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


class Adam:
    """Adam on a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) / len(y) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w
