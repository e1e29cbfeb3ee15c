"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of letters, lower-cased; a token's features are itself and its
first three to eight bytes where it is longer, hashed into one weight table.  The
field has two states and a 2 x 2 transition matrix; a chain is a whole text.  Its
marginals are computed a block of tokens at a time: the product of a block's
transfer matrices takes a message across it in one step, so that the blocks of
all texts run side by side.  Training takes blocks of the sample as chains of
their own.

Only documents have labels, so token labels are derived from them: features
that occur (once, or several times) in many toxic documents of the sample and
hardly in clean ones, or that explain toxic documents which no other does, are
incriminated; a token of a toxic document that has such a feature is labelled
toxic, all others clean.  The field is trained on those labels by
forward-backward and Adagrad.  Its marginals give the spans; their maximum and sum over the
whole text give the document score, by a logistic layer fitted on the documents.

Defined cases: null and empty texts have no tokens and get the score of a text
without any toxic token; where no row can be learnt from, every score is 0;
other columns than doc_id and text are ignored; an empty table gives an empty
result.  Span offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import flat, held_out, labelled_sample, logistic, sigmoid
from ._seq import U64, Prefix, alphabet, chunks, column_bytes, letter_runs, lower_ascii, mix
from ._shared import bare_documents, tune

#: Tokens of a block.
BLOCK = 64
TABLE_BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: A span is a run of tokens whose marginal is at least this.
SPAN = 0.5


def features(buf: np.ndarray, offsets: np.ndarray, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (a row for each token), starts, ends, first token of each text."""
    low = lower_ascii(buf)
    s, e, first = letter_runs(low, offsets)
    prefix = Prefix(alphabet()[low])
    out = np.empty((len(s), 1 + len(PREFIXES)), np.int32)
    shift = U64(64 - bits)
    out[:, 0] = (mix(prefix.of(s, e) + U64(101)) >> shift).astype(np.int32)
    for i, n in enumerate(PREFIXES):
        # a word and longer words that begin with it differ; a token of n bytes or fewer is itself
        part = (mix(prefix.of(s, np.minimum(s + n, e)) + U64(n)) >> shift).astype(np.int32)
        out[:, i + 1] = np.where(e - s > n, part, out[:, 0])
    return out, s, e, first


def blocks(first: np.ndarray, length: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of each block of each text."""
    n = np.diff(first)
    parts = -(-n // length)
    text = np.repeat(np.arange(len(n)), parts)
    start = first[:-1][text] + length * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
    return start, np.minimum(start + length, first[1:][text]) - start


class Field:
    """emission[f]: weight of state 1 against state 0 (the state 0 has weight 0)."""

    def __init__(self, bits: int = TABLE_BITS):
        self.emission = np.zeros(1 << bits, np.float32)
        self.bias = np.float32(-4.0)
        self.transition = np.zeros((2, 2))
        self.document = np.array([0.0, 0.0, 0.0])

    def marginals(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, pairs: bool = False):
        """Marginal of state 1 for each token, by scaled forward-backward over
        all chains at once; with ``pairs``, also expected transition counts."""
        score = self.emission[rows].sum(1, dtype=np.float64) + self.bias
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        longest = int(size[0]) if len(size) else 0
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]  # chains of more than t tokens
        t = np.exp(self.transition)
        odds = np.exp(np.clip(score, -30, 30))
        forward = np.empty((longest, len(size), 2))
        for k in range(longest):
            n = live[k]
            on = odds[start[:n] + k]
            if k == 0:
                a0, a1 = np.ones(n), on
            else:
                f = forward[k - 1, :n]
                a0, a1 = f[:, 0] * t[0, 0] + f[:, 1] * t[1, 0], (f[:, 0] * t[0, 1] + f[:, 1] * t[1, 1]) * on
            total = a0 + a1
            forward[k, :n, 0], forward[k, :n, 1] = a0 / total, a1 / total
        out = np.zeros(len(rows))
        expected = np.zeros((2, 2))
        b0, b1 = np.ones(len(size)), np.ones(len(size))
        for k in range(longest - 1, -1, -1):
            n = live[k]
            f = forward[k, :n]
            p0, p1 = f[:, 0] * b0[:n], f[:, 1] * b1[:n]
            out[start[:n] + k] = p1 / (p0 + p1)
            if k:
                on = odds[start[:n] + k] * b1[:n]
                back = b0[:n]
                if pairs:
                    g = forward[k - 1, :n]
                    cells = [[g[:, 0] * t[0, 0] * back, g[:, 0] * t[0, 1] * on], [g[:, 1] * t[1, 0] * back, g[:, 1] * t[1, 1] * on]]
                    total = sum(c for r in cells for c in r)
                    expected += [[(c / total).sum() for c in r] for r in cells]
                c0, c1 = t[0, 0] * back + t[0, 1] * on, t[1, 0] * back + t[1, 1] * on
                total = c0 + c1
                b0[:n], b1[:n] = c0 / total, c1 / total
        return (out, expected) if pairs else out

    def text_marginals(self, rows: np.ndarray, first: np.ndarray, length: int = BLOCK) -> np.ndarray:
        """Marginal of state 1 for each token, each text being one chain."""
        odds = np.exp(np.clip(self.emission[rows].sum(1, dtype=np.float64) + self.bias, -30, 30))
        start, size = blocks(first, length)
        out = np.zeros(len(rows))
        if not len(start):
            return out
        text = np.searchsorted(first, start, "right") - 1
        head = start == first[text]
        order = np.argsort(-size, kind="stable")
        start, size, head = start[order], size[order], head[order]
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) + 1)]
        t = np.exp(self.transition)

        def step(a, k):
            """Message a (.., 2) taken to token k of the blocks that have one."""
            on = odds[start[: len(a)] + k]
            on = on.reshape(on.shape + (1,) * (a.ndim - 2))
            moved0, moved1 = a[..., 0] * t[0, 0] + a[..., 1] * t[1, 0], a[..., 0] * t[0, 1] + a[..., 1] * t[1, 1]
            if k == 0:  # no transition leads to the first token of a text
                none = head.reshape(head.shape + (1,) * (a.ndim - 2))
                moved0, moved1 = np.where(none, a[..., 0], moved0), np.where(none, a[..., 1], moved1)
            return np.stack([moved0, moved1 * on], -1)

        # the transfer matrix of each block, then messages from block to block
        product = np.broadcast_to(np.eye(2), (len(start), 2, 2)).copy()
        for k, n in enumerate(live[:-1]):
            p = step(product[:n], k)
            product[:n] = p / p.sum((1, 2), keepdims=True)
        block = np.empty(len(order), np.int64)
        block[order] = np.arange(len(order))  # blocks in the order of texts
        turn = np.arange(len(block)) - np.searchsorted(text, text, "left")
        left, right = np.ones((len(start), 2)), np.ones((len(start), 2))
        by_turn = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by_turn], np.arange(1, int(turn.max()) + 1))
        for own in np.split(by_turn, cuts)[1:]:
            m = np.einsum("ni,nij->nj", left[block[own - 1]], product[block[own - 1]])
            left[block[own]] = m / m.sum(1, keepdims=True)
        for own in np.split(by_turn, cuts)[:0:-1]:
            m = np.einsum("nij,nj->ni", product[block[own]], right[block[own]])
            right[block[own - 1]] = m / m.sum(1, keepdims=True)

        forward = np.empty((len(live) - 1, len(start), 2))
        a = left
        for k, n in enumerate(live[:-1]):
            a = step(a[:n], k)
            a = forward[k, :n] = a / a.sum(1, keepdims=True)
        for k in range(len(live) - 2, -1, -1):
            n = live[k]
            p = forward[k, :n] * right[:n]
            out[start[:n] + k] = p[:, 1] / p.sum(1)
            if k:
                b0, b1 = right[:n, 0], right[:n, 1] * odds[start[:n] + k]
                b = np.column_stack([t[0, 0] * b0 + t[0, 1] * b1, t[1, 0] * b0 + t[1, 1] * b1])
                right[:n] = b / b.sum(1, keepdims=True)
        return out

    def fit(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 2048, seed: int = 3) -> None:
        """Adagrad on the likelihood of the token labels."""
        random = np.random.default_rng(seed)
        seen, seen_t, seen_b = np.ones(len(self.emission), np.float32), np.ones((2, 2)), 1.0
        # chains with a toxic token, and as many others at least
        token_chain = np.repeat(np.arange(len(start)), size)
        hot = np.bincount(token_chain, weights=y[np.repeat(start, size) + _within(size)], minlength=len(start)) > 0
        cold = np.flatnonzero(~hot)
        chosen = np.concatenate([np.flatnonzero(hot), random.permutation(cold)[: max(2000, 3 * int(hot.sum()))]])
        for _ in range(epochs):
            for part in np.array_split(random.permutation(chosen), max(1, len(chosen) // batch)):
                n = size[part]
                at = np.repeat(start[part], n) + _within(n)
                own = np.cumsum(n) - n
                x, t = rows[at], y[at]
                p, expected = self.marginals(x, own, n, pairs=True)
                counts = np.zeros((2, 2))
                inner = _within(n) > 0
                np.add.at(counts, (t[:-1][inner[1:]].astype(int), t[1:][inner[1:]].astype(int)), 1)
                g = np.bincount(x.ravel(), weights=np.repeat(t - p, x.shape[1]), minlength=len(self.emission)).astype(np.float32)
                seen += g * g
                self.emission += 0.5 * g / np.sqrt(seen)
                g_t = counts - expected
                seen_t += g_t * g_t
                self.transition += 0.1 * g_t / np.sqrt(seen_t)
                g_b = float((t - p).sum())
                seen_b += g_b * g_b
                self.bias += np.float32(0.1 * g_b / seen_b**0.5)

    def summary(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Greatest marginal and the logarithm of their sum, for each text."""
        n = len(first) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        top = np.zeros(n)
        np.maximum.at(top, text, p)
        return np.column_stack([top, np.log1p(np.bincount(text, weights=p, minlength=n))])

    def score(self, summary: np.ndarray) -> np.ndarray:
        return sigmoid(summary @ self.document[:-1] + self.document[-1])


def _within(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def token_labels(rows: np.ndarray, first: np.ndarray, y: np.ndarray, bits: int = TABLE_BITS, least: int = 5, share: float = 0.05, common: float = 0.03, times: int = 3) -> np.ndarray:
    """1 for tokens of toxic texts with an incriminated feature.

    Suspects are features that ``least`` toxic texts hold so many times (once, or
    twice, up to ``times``) and, beside them, at most ``share`` as many clean ones
    do.  Incriminated are those that a share ``common`` of the toxic texts hold,
    and then, one by one, the suspect that explains most toxic texts not
    explained yet, while it explains ``least``."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def held():
        """Text, feature and how often the text holds it; some texts at a time."""
        cuts = [*range(0, len(y), 100), len(y)]
        for p, q in ((first[a], first[b]) for a, b in zip(cuts[:-1], cuts[1:])):
            # a short token stands for its prefixes too, and counts once
            once = np.ones((q - p, rows.shape[1]), bool)
            once[:, 1:] = rows[p:q, 1:] != rows[p:q, :1]
            pairs, n = np.unique((text[p:q, None] * (1 << bits) + rows[p:q])[once], return_counts=True)
            yield pairs >> bits, pairs & ((1 << bits) - 1), n

    counts = np.zeros((2, times + 1, 1 << bits))
    for of, feature, n in held():
        for m in range(1, times + 1):
            for label in (0, 1):
                counts[label, m] += np.bincount(feature[(n >= m) & (y[of] == label)], minlength=1 << bits)
    level, strong = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
    for m in range(times, 0, -1):
        clean, toxic = counts[:, m]
        suspect = (toxic >= least) & (clean <= share * toxic)
        level[suspect], strong[suspect] = m, toxic[suspect]
    kept = [(of[on], feature[on]) for of, feature, n in held() for on in [(level[feature] > 0) & (n >= level[feature]) & (y[of] > 0)]]
    of, feature = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 2
    bad = strong >= max(least, common * y.sum())
    explained = np.zeros(len(y), bool)
    explained[of[bad[feature]]] = True
    while True:
        left = np.bincount(feature, weights=~explained[of], minlength=1 << bits)
        best = int(left.argmax())
        if left[best] < least:
            break
        bad[best] = True
        explained[of[feature == best]] = True
    return (bad[rows].any(1) & (y[text] > 0)).astype(np.float64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, kept_out: int = 1) -> Field | None:
    texts, y, weight = labelled_sample(docs, labels, "toxic", modulus, kept_out)
    if not texts:
        return None
    buf, offsets = flat(texts)
    parts = [features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
    rows = np.concatenate([p[0] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])
    del parts
    field = Field()
    field.fit(rows, *blocks(first), token_labels(rows, first, y))
    # some texts at a time bound the scratch arrays
    cuts = [*range(0, len(y), 200), len(y)]
    p = np.concatenate([field.text_marginals(rows[first[a] : first[b]], first[a : b + 1] - first[a]) for a, b in zip(cuts[:-1], cuts[1:])])
    field.document = logistic(field.summary(p, first), y, weight)
    return field


def _score(field: Field | None, threshold: float, spans: bool):
    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            score, found = np.zeros(len(offsets) - 1), [[] for _ in range(len(offsets) - 1)]
            if field:
                for i, j in chunks(offsets):
                    rows, s, e, first = features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    p = field.text_marginals(rows, first)
                    score[i:j] = field.score(field.summary(p, first))
                    if spans:
                        hot = np.flatnonzero(p >= SPAN)
                        text = np.searchsorted(first, hot, "right") - 1
                        for t, k in zip(text, hot):
                            low, high = int(s[k] - (offsets[i + t] - offsets[i])), int(e[k] - (offsets[i + t] - offsets[i]))
                            own = found[i + t]
                            if own and own[-1]["token"] == k - 1:
                                own[-1] |= {"end": high, "token": k}
                            else:
                                own.append({"start": low, "end": high, "token": k})
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            names = ["doc_id", "held_out", "score", "predicted"]
            if spans:
                columns.append(pa.array([[{"start": x["start"], "end": x["end"]} for x in own] for own in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, kept_out: int = 1, threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and, if asked for, the toxic spans."""
    tune(docs.sparkSession)
    texts = bare_documents(docs)
    field = fit_toxicity(texts, labels, modulus, kept_out)
    schema = "doc_id long, held_out boolean, score double, predicted int" + ", spans array<struct<start: long, end: long>>" * spans
    return texts.withColumn("held_out", held_out(modulus, kept_out)).mapInArrow(_score(field, threshold, spans), schema)
