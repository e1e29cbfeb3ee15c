"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, each
filter keeps its greatest response in the window (max pooling), and a softmax
layer turns the responses into languages.  Windows overlap by the widest filter
less one byte and cover the whole text; their probabilities are averaged.

A filter is a table of 256 numbers for each of its bytes, so a response is a sum
of table entries; tables of byte pairs halve the look-ups.  Training is plain
numpy on the driver, on a bounded sample.

Defined cases: null text and text without a letter are ``und`` with score 0;
where no row can be learnt from, every text is ``und``; other columns than
doc_id, text and lang are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._fit import Adam, flat, held_out, within
from ._seq import chunks, column_bytes
from ._shared import tune

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
#: Documents of each language to learn from at most, as a rule; of them the first,
#: in the order of a hash, whose whole texts have so many characters together; and
#: the characters of all languages (a share of at least one document for each).
SAMPLE_ROWS = 1200
SAMPLE_CHARS = 1_000_000
SAMPLE_CHARS_ALL = 24_000_000
NONE = "und"


def windows_of(buf: np.ndarray, offsets: np.ndarray, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of bytes, zero after the end of the text), their texts, and
    the bytes of the text in each."""
    stride = window - overlap
    sizes = np.diff(offsets)
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - overlap) // stride)), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    start = offsets[:-1][text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    end = np.minimum(start + window, offsets[1:][text])
    at = start[:, None] + np.arange(window)
    rows = buf[np.minimum(at, max(len(buf) - 1, 0))] if len(buf) else np.zeros((0, window), np.uint8)
    rows[at >= end[:, None]] = 0
    return rows, text, end - start


class ByteNet:
    """taps: for each width, (width, 256, filters); out: (filters in all, languages)."""

    def __init__(self, languages: list[str], widths=WIDTHS, filters: int = FILTERS, seed: int = 1):
        random = np.random.default_rng(seed)
        self.languages, self.widths, self.filters = languages, widths, filters
        self.taps = [random.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.out = random.normal(0, 0.1, (filters * len(widths), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Greatest response of each filter in each window (and where it is)."""
        best, places = [], []
        for taps in self.taps:
            span = rows.shape[1] - max(self.widths) + 1
            a = taps[0][rows[:, :span]]
            for j in range(1, len(taps)):
                a += taps[j][rows[:, j : j + span]]
            if where:
                place = a.argmax(1)
                places.append(place)
                best.append(np.take_along_axis(a, place[:, None, :], 1)[:, 0])
            else:
                best.append(a.max(1))
        return np.concatenate(best, 1), places

    def fast(self):
        """As ``pooled`` for widths up to four, by two tables of byte pairs."""
        low = np.zeros((256, 256, self.filters * len(self.widths)), np.float32)
        high = np.zeros_like(low)
        for i, taps in enumerate(self.taps):
            on = slice(i * self.filters, (i + 1) * self.filters)
            for j, tap in enumerate(taps):
                to = low if j < 2 else high
                to[:, :, on] += tap[:, None, :] if j % 2 == 0 else tap[None, :, :]
        low, high = low.reshape(65536, -1), high.reshape(65536, -1)

        def pooled(rows: np.ndarray) -> np.ndarray:
            out = np.empty((len(rows), low.shape[1]), np.float32)
            for i in range(0, len(rows), 32):  # small enough for a core's cache
                part = rows[i : i + 32].astype(np.int64)
                pairs = part[:, :-1] * 256 + part[:, 1:]
                span = part.shape[1] - 3
                a = np.take(low, pairs[:, :span], axis=0)
                a += np.take(high, pairs[:, 2 : 2 + span], axis=0)
                a.max(1, out=out[i : i + 32])
            return out

        return pooled

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def fit(self, rows: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, seed: int = 2) -> None:
        random = np.random.default_rng(seed)
        adam = Adam([*self.taps, self.out, self.bias], 0.01)
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for i in range(0, len(order), batch):
                x, t = rows[order[i : i + batch]], y[order[i : i + batch]]
                pooled, places = self.pooled(x, where=True)
                g = self.probabilities(pooled)
                g[np.arange(len(t)), t] -= 1
                g /= len(t)
                active = np.maximum(pooled, 0)
                back = (g @ self.out.T) * (pooled > 0)
                gradients = []
                for w, (taps, place) in enumerate(zip(self.taps, places)):
                    grad = np.zeros_like(taps)
                    b = back[:, w * self.filters : (w + 1) * self.filters]
                    for j in range(len(taps)):
                        byte = np.take_along_axis(x, place + j, 1)
                        np.add.at(grad[j], (byte, np.arange(self.filters)[None, :]), b)
                    gradients.append(grad)
                adam.step([*gradients, active.T @ g + 1e-4 * self.out, g.sum(0)])


def fit_language_model(docs: DataFrame, learn: F.Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, window: int = WINDOW) -> ByteNet | None:
    """A network for all languages, fitted on whole texts of a bounded sample of
    each among the documents that ``learn`` admits; None if there are none."""
    usable = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").toArrow()
    if not len(counts):
        return None
    languages = counts.column("lang").to_pylist()
    chars = max(window, min(chars, SAMPLE_CHARS_ALL // len(languages)))
    spark = docs.sparkSession
    # twice the rows that are wanted, on average, so that hardly any language lacks some
    share = spark.createDataFrame([(x, min(1.0, 2 * rows / n)) for x, n in zip(languages, counts.column("n").to_pylist())], "lang string, share double")
    lot = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    sample = usable.join(F.broadcast(share), "lang").where(lot < F.col("share")).withColumn("turn", turn).where(F.col("turn") <= rows).drop("turn", "share")
    got = within(sample, chars, "lang").orderBy("lang", "doc_id", "text").toArrow()
    texts = got.column("text").to_pylist()
    if not texts:
        return None
    found, of, _ = windows_of(*flat(texts), window, max(WIDTHS) - 1)
    net = ByteNet(languages)
    number = {x: i for i, x in enumerate(languages)}
    net.fit(found, np.array([number[x] for x in got.column("lang").to_pylist()])[of])
    return net


def _predict(net: ByteNet | None, window: int):
    def run(batches):
        pooled = net.fast() if net else None
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            letters = np.asarray(batch.column("letters").fill_null(False).cast(pa.int8())) > 0
            names, scores = np.full(len(letters), NONE, object), np.zeros(len(letters))
            if net:
                for i, j in chunks(offsets):
                    rows, text, size = windows_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, max(net.widths) - 1)
                    if not len(rows):
                        continue
                    p = net.probabilities(pooled(rows)) * size[:, None]
                    total = np.zeros((j - i, p.shape[1]))
                    np.add.at(total, text, p)
                    total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
                    on = letters[i:j]
                    names[i:j][on] = np.array(net.languages, object)[total.argmax(1)][on]
                    scores[i:j][on] = total.max(1)[on]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, modulus: int = 4, kept_out: int = 2, window: int = WINDOW) -> DataFrame:
    """doc_id, held_out, lang_pred, score.  Rows whose crc32 of the id leaves
    ``kept_out`` are not learnt from."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit_language_model(texts, F.col("doc_id").isNotNull() & ~held_out(modulus, kept_out), window=window)
    marked = texts.select("doc_id", "text", held_out(modulus, kept_out).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return marked.mapInArrow(_predict(net, window), "doc_id long, held_out boolean, lang_pred string, score double")
