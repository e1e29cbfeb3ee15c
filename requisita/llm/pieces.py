"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once.  At each end of a
match it follows the output links from the longest piece to the shortest, and
each relaxes the best score of a segmentation that ends there: a single-pass
Viterbi.  A character that no piece holds is an unknown one, worth ten less than
the least score, and is written as byte pieces where the model has them.

No piece of the usual models crosses from a letter to the blank that starts the
next word; texts are then cut there, segmentation being independent on both
sides, and a worker keeps the pieces of the words that it has met (``KEPT`` at
most).  A model with other pieces has its texts segmented whole.

The model file is a parameter.  Segmentation is by best score for any model, so
for a model that was trained by merges the pieces are those of its vocabulary but
not always those that merging would give.  Decoding returns the text either way, but
for the sign "▁", which becomes a blank.

Defined cases: null text has null ids; empty text has none; rows repeated get
equal results; an empty table gives an empty result; other columns are ignored.
A null character or unpaired surrogate is written as bytes like any unknown one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bare_documents, tune

BLANK = "▁"
KEPT = 200_000


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str | bytes):
        import ahocorasick
        import sentencepiece

        own = {"model_proto": model} if isinstance(model, bytes) else {"model_file": model}
        m = sentencepiece.SentencePieceProcessor(**own)
        self.automaton = ahocorasick.Automaton()
        self.pieces: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown = m.unk_id()
        least, one_blank, crossing, blanks = 0.0, None, False, []
        for i in range(m.vocab_size()):
            piece, score = m.id_to_piece(i), m.get_score(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.pieces.append(bytes([int(piece[3:5], 16)]))
                continue
            if m.is_control(i) or m.is_unused(i) or m.is_unknown(i):
                self.pieces.append(b"" if not m.is_unknown(i) else b" \xe2\x81\x87 ")
                continue
            self.pieces.append(piece.replace(BLANK, " ").encode("utf-8"))
            self.automaton.add_word(piece, (len(piece), i, score))
            least = min(least, score)
            if piece == BLANK:
                one_blank = score
            elif piece.strip(BLANK) == "":
                blanks.append((len(piece), score))
            crossing |= BLANK in piece.lstrip(BLANK)
        self.automaton.make_automaton()
        self.unknown_score = least - 10
        # runs of blanks as one piece never win if single blanks always score more
        self.plain_blanks = not crossing and one_blank is not None and all(s < n * one_blank for n, s in blanks)
        self.whole = crossing
        self.units = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.kept: dict[str, bytes] = {}

    def segment(self, unit: str) -> list[int]:
        """Piece ids of best total score; the longest last piece wins ties."""
        n = len(unit)
        best = [0.0] + [None] * n
        back = [None] * (n + 1)
        done = 0

        def unknowns(to):
            # positions that no piece ends at can only be reached by an unknown character
            nonlocal done
            while done < to:
                done += 1
                cost = best[done - 1] + self.unknown_score
                if best[done] is None or (not covered[done] and cost > best[done]):
                    best[done], back[done] = cost, (1, -1)

        covered = [False] * (n + 1)  # whether a piece of one character ends there
        for end, (size, i, score) in self.automaton.iter(unit):
            unknowns(end)
            cost = best[end + 1 - size] + score
            if best[end + 1] is None or cost > best[end + 1]:
                best[end + 1], back[end + 1] = cost, (size, i)
            if size == 1:
                covered[end + 1] = True
        unknowns(n)
        out = []
        while n:
            size, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                raw = unit[n - 1].encode("utf-8", "surrogatepass")
                ids = [self.byte_ids[b] for b in raw]
                out += ids[::-1] if min(ids) >= 0 else [self.unknown]
            n -= size
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.plain_blanks:
            units = [BLANK + x for x in text.replace(BLANK, " ").split(" ")]
        else:
            units = BLANK + text.replace(" ", BLANK)
            units = [units] if self.whole else self.units.findall(units)
        kept, out = self.kept, []
        for unit in units:
            found = kept.get(unit)
            if found is None:
                found = np.array(self.segment(unit), np.int32).tobytes()
                if len(unit) < 64:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[unit] = found
            out.append(found)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        pieces = self.pieces
        raw = b"".join([pieces[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model_bytes(model: str) -> bytes:
    """The file is read on the driver, and its bytes go with the tasks."""
    with open(model, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids: the piece ids of each whole text."""
    tune(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(_model_bytes(model or default_model()))

    def run(batches):
        codec = PieceCodec(data.value)
        for batch in batches:
            ids = [None if t is None else codec.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return bare_documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of doc_id, ids."""
    tune(encoded.sparkSession)
    data = encoded.sparkSession.sparkContext.broadcast(_model_bytes(model or default_model()))

    def run(batches):
        codec = PieceCodec(data.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian int32), exact
    (whether decoding the ids gives the text again).  A text that holds the sign
    that stands for a blank is not given back: it is decoded as a blank."""
    tune(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(_model_bytes(model or default_model()))

    def run(batches):
        codec = PieceCodec(data.value)
        for batch in batches:
            n, sha, exact = [], [], []
            for text in batch.column("text").to_pylist():
                if text is None:
                    n.append(None), sha.append(None), exact.append(None)
                    continue
                ids = codec.encode(text)
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                exact.append(codec.decode(ids.tolist()) == text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(exact, pa.bool_())], names=["doc_id", "n_pieces", "ids_sha256", "exact"])

    return bare_documents(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, exact boolean")
