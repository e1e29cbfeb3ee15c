"""Quality scores from random-indexing word vectors and a two-layer network.

Random indexing: each of ``buckets`` hashed words has a sparse index vector of
+1 and -1; a word's vector is the sum of the index vectors of the words around
it in all documents, normalised, plus its own.  Words are runs of one class of
bytes (small letters, capitals, digits, signs), and each also counts by its
shape (class and length, or that it repeats the word before), so that words never
seen still say something.  The
vectors of all words of the whole text are pooled into their mean, its length
and the logarithm of the number of words.  A network with one hidden layer gives
the score, with a temperature fitted on rows that the network has not seen.

Defined cases: null and empty texts pool to zero and are scored like any text;
where no row can be learnt from, every score is 0.5; other columns than doc_id
and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import SAMPLE_ROWS, Adam, class_weights, held_out, picked_labels, sigmoid
from ._seq import U64, Prefix, alphabet, chunks, column_bytes, mix
from ._shared import bare_documents, tune

BUCKETS = 8192
DIMENSIONS = 48
HIDDEN = 24
THRESHOLD = 0.3
_SHAPES = 64
#: The shape of a word that stands there once more.
_AGAIN = 60


def byte_classes() -> np.ndarray:
    """0 white space, 1 small letter or other alphabet, 2 capital, 3 digit, 4 sign."""
    c = np.full(256, 4, np.int8)
    c[128:] = 1
    c[97:123], c[65:91], c[48:58] = 1, 2, 3
    c[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return c


def tokens(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape bucket and text of each run of one class."""
    n = len(buf)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    kind = byte_classes()[buf]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    head = head[:n]
    head[1:] |= kind[1:] != kind[:-1]
    s = np.flatnonzero(head)
    e = np.append(s[1:], n)
    on = kind[s] > 0
    s, e = s[on], e[on]
    h = mix(Prefix(alphabet()[buf]).of(s, e) + (e - s).astype(U64))
    word = _SHAPES + (h % U64(buckets - _SHAPES)).astype(np.int64)
    shape = kind[s].astype(np.int64) * 12 + np.minimum(e - s, 11)
    text = np.searchsorted(offsets, s, "right") - 1
    again = np.zeros(len(s), bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    again[2:] |= (word[2:] == word[:-2]) & (text[2:] == text[:-2]) & (kind[s[2:]] < 3)  # a sign between
    shape[again] = _AGAIN
    return word, shape, text


def index_vectors(buckets: int, dimensions: int, ones: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    h = mix(np.arange(1, buckets * ones + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(buckets, ones)
    return (h % U64(dimensions)).astype(np.int64), np.where((h >> U64(40)) & U64(1), 1.0, -1.0)


def _context(buckets: int, dimensions: int, reach: int):
    """Sums over all texts of a task: a row for each bucket that has any."""

    def run(batches):
        place, sign = index_vectors(buckets, dimensions)
        total = np.zeros(buckets * dimensions)
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                word, _, text = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                for d in range(1, reach + 1):
                    same = text[d:] == text[:-d]
                    for a, b in ((word[d:][same], word[:-d][same]), (word[:-d][same], word[d:][same])):
                        for e in range(place.shape[1]):
                            total += np.bincount(a * dimensions + place[b, e], weights=sign[b, e], minlength=buckets * dimensions)
        sums = total.reshape(buckets, dimensions).astype(np.int64)
        on = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *(pa.array(c) for c in sums[on].T)], names=["bucket", *(f"c{d}" for d in range(dimensions))])

    return run


def context_sums(texts: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, reach: int = 2) -> np.ndarray:
    """Sum of the index vectors around each bucket's words.  All terms are whole
    numbers, so the order of texts does not matter."""
    names = [f"c{d}" for d in range(dimensions)]
    parts = texts.select("text").mapInArrow(_context(buckets, dimensions, reach), "bucket int, " + ", ".join(f"{c} long" for c in names))
    got = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    total = np.zeros((buckets, dimensions))
    total[got.column("bucket").to_numpy()] = np.column_stack([got.column(c).to_numpy() for c in names])
    return total


def word_vectors(total: np.ndarray) -> np.ndarray:
    """Normalised context sums plus own index vectors; shapes have only those."""
    buckets, dimensions = total.shape
    place, sign = index_vectors(buckets, dimensions)
    vectors = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    own = np.zeros((buckets, dimensions))
    for j in range(place.shape[1]):
        np.add.at(own, (np.arange(buckets), place[:, j]), sign[:, j] / 2)
    return vectors + own


def pool(buf: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """Mean vector over all words, mean over their shapes, lengths of both, and
    the logarithm of the number of words."""
    n, buckets = len(offsets) - 1, len(vectors)
    word, shape, text = tokens(buf, offsets, buckets)
    count = np.bincount(text, minlength=n)[:, None]
    means = [np.zeros((n, vectors.shape[1])) for _ in range(2)]
    for i in range(0, len(text), most):  # so many words at a time bound the memory
        own = text[i : i + most]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for mean, bucket in zip(means, (word, shape)):
            mean[own[heads]] += np.add.reduceat(vectors[bucket[i : i + most]], heads)
    for mean in means:
        mean /= np.maximum(count, 1)
    return np.hstack([*means, *(np.linalg.norm(m, axis=1, keepdims=True) for m in means), np.log1p(count) / 10])


class Network:
    """Two layers, trained by Adam on weighted cross-entropy, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 5):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        order = random.permutation(len(z))
        keep, test = order[len(z) // 5 :], order[: len(z) // 5]
        self.w1 = random.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden))
        self.b1, self.w2, self.b2 = np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.temperature = 1.0
        adam = Adam([self.w1, self.b1, self.w2, self.b2], 0.01)
        for epoch in range(epochs):
            if epoch == epochs * 2 // 3:
                adam.rate = 0.002
            for part in np.array_split(random.permutation(keep), max(1, len(keep) // 64)):
                if not len(part):
                    continue
                a = np.tanh(z[part] @ self.w1 + self.b1)
                g = weight[part] * (sigmoid(a @ self.w2 + self.b2) - y[part]) / len(part)
                back = g[:, None] * self.w2 * (1 - a * a)
                adam.step([z[part].T @ back + 1e-3 * self.w1, back.sum(0), a.T @ g + 1e-3 * self.w2, g.sum(keepdims=True)])
        if len(test):
            logit = self._logit(x[test])
            loss = lambda t: -(weight[test] * (y[test] * np.log(sigmoid(logit / t)) + (1 - y[test]) * np.log(sigmoid(-logit / t)))).sum()
            self.temperature = float(min(np.geomspace(0.5, 5, 60), key=loss))

    def _logit(self, x):
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._logit(x) / self.temperature)


def _pooled(vectors: np.ndarray):
    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                x = pool(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vectors)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("y").slice(i, j - i), lists], names=["doc_id", "y", "x"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, kept_out: int = 0, rows: int = SAMPLE_ROWS):
    """Word vectors of all documents and a network fitted on labelled ones, or
    None where nothing can be learnt from.  Whole texts are read on executors;
    sums and pooled numbers come to the driver."""
    picked, counts = picked_labels(labels, "quality", modulus, kept_out, rows)
    if picked is None:
        return None
    sample = bare_documents(docs).join(F.broadcast(picked), "doc_id")
    vectors = word_vectors(context_sums(bare_documents(docs)))
    pooled = sample.mapInArrow(_pooled(vectors), "doc_id long, y int, x array<double>")
    got = pooled.orderBy("doc_id", "y", "x").limit(4 * rows).toArrow().combine_chunks()
    if not len(got):
        return None
    y = got.column("y").to_numpy().astype(np.float64)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    return vectors, Network(x, y, class_weights(y, counts))


def _score(model, threshold: float):
    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            score = np.full(len(offsets) - 1, 0.5)
            if model:
                for i, j in chunks(offsets):
                    score[i:j] = model[1].score(pool(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, kept_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    tune(docs.sparkSession)
    texts = bare_documents(docs)
    model = fit_quality(texts, labels, modulus, kept_out)
    return texts.withColumn("held_out", held_out(modulus, kept_out)).mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text is not rejected."""
    tune(docs.sparkSession)
    model = fit_quality(bare_documents(docs), labels)

    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            if model:
                keep = np.concatenate([model[1].score(pool(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model[0])) >= threshold for i, j in chunks(offsets)] or [np.zeros(0, bool)])
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
