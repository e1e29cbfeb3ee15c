"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are words ``[^\\x20\\x09-\\x0D]+``.  A document longer than the longest
sequence is cut into full sequences and a rest.  Pieces are dealt to shards of
bounded size by hash, and each shard is packed by one task: pieces in falling
order of length, each into the open sequence that it leaves the least room in.
Where none has room, one is opened, of the permitted length with the least
expected cost a word: the length and a fixed cost, over the piece and what
shorter pieces may still fill.  In the end each sequence is downsized to the
least permitted length that holds its contents.

Defined cases: null and empty texts, and texts without words, have length 0 and
no sequence (bin, capacity and place are null); equal lengths go by doc_id, nulls
first; rows repeated in full are packed each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._seq import chunks, column_bytes, words
from ._shared import Workspace, bare_documents, tune

CAPACITIES = (256, 512, 1024, 2048)
#: What opening a sequence costs, in words, beside its length.
OPENING = 16
#: Pieces of a shard, on average.
SHARD_PIECES = 20_000


def pack(lengths: np.ndarray, capacities=CAPACITIES, opening: int = OPENING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each piece, and capacity of each bin, for pieces in
    falling order of length, none longer than the largest capacity."""
    capacities = sorted(capacities)
    n = len(lengths)
    rising = lengths[::-1]
    mass = np.concatenate([[0], np.cumsum(rising)])  # words of the pieces of at most some length
    bin_of, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    used: list[int] = []
    for i, size in enumerate(lengths.tolist()):
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            best = None
            for c in capacities:
                if c < size:
                    continue
                # pieces that come later and fit in what is left
                later = min(int(np.searchsorted(rising, c - size, "right")), n - i - 1)
                fill = min(c - size, int(mass[later]))
                cost = (c + opening) / (size + fill)
                if best is None or cost < best[0]:
                    best = (cost, c)
            left, b = best[1], len(used)
            used.append(0)
        bin_of[i], place[i] = b, used[b]
        used[b] += size
        bisect.insort(room, (left - size, b))
    sizes = np.array(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bin_of, place, sizes


def _lengths(batches):
    for batch in batches:
        buf, offsets = column_bytes(batch.column("text"))
        n = [np.diff(words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2]) for i, j in chunks(offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n or [[]]).astype(np.int64))], names=["doc_id", "length"])


def _pack_shards(capacities, opening: int):
    """Reads rows ordered by shard, falling length, doc_id, piece."""

    def solve(t: pa.Table):
        size = np.asarray(t.column("length"))
        on = size > 0
        bins, place, capacity = pack(size[on], capacities, opening)
        shard = t.column("shard")[0].as_py()
        out = {x: np.zeros(len(size), np.int64) for x in ("bin", "capacity", "place")}
        out["bin"][on], out["place"][on], out["capacity"][on] = (shard << 32) + bins, place, capacity[bins]
        columns = [t.column(x).combine_chunks() for x in ("doc_id", "piece", "start", "length")]
        columns += [pa.array(out[x], mask=np.asarray(~on)) for x in ("bin", "capacity", "place")]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "bin", "capacity", "place"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and shard[a] != key:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                key = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def pack_documents(docs: DataFrame, capacities=CAPACITIES, opening: int = OPENING, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start (first word), length, bin, capacity, place (in the
    sequence): one row for each piece."""
    tune(docs.sparkSession)
    work = Workspace(docs.sparkSession)
    most = max(capacities)
    # the number of a row is fixed by writing it; it deals equal rows to different shards
    lengths = bare_documents(docs).mapInArrow(_lengths, "doc_id long, length long").withColumn("row", F.monotonically_increasing_id())
    lengths = work.keep(lengths.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("length") / most)).cast("int")), "lengths")
    shards = max(1, math.ceil((lengths.agg(F.sum("pieces")).first()[0] or 0) / shard_pieces))
    cut = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * most).alias("start"),
        F.least(F.lit(most), F.col("length") - F.col("piece").cast("long") * most).alias("length"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
    )
    dealt = cut.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), F.asc_nulls_first("doc_id"), "piece")
    return dealt.mapInArrow(_pack_shards(tuple(capacities), opening), "doc_id long, piece int, start long, length long, bin long, capacity long, place long")
