"""Substring deduplication by de Bruijn compaction over words.

An edge of the graph is a word k-mer (k = ``width`` = 35 consecutive words of
one text).  Edges are bucketed by minimiser, and a run of edges of one text with
one minimiser moves as one row (`repeats`).  Spark joins on (minimiser, run) find
the runs that are taken twice; runs that share a minimiser but not all words
branch somewhere: they are opened into single edges, which are joined on
(minimiser, edge).  Repeated runs meet at nodes; where a node does not branch, a
Spark join puts the two together, until only long paths are left
(`repeats.compact`); repeated single edges are put together along their source.

Each path has source coordinates: the texts and places where it stands.  The
words there are brought together and compared.  If those of any path differ (a
collision of fingerprints), the search starts again under other fingerprints; so
no word is cut that was not seen to repeat, and none that repeats is missed.

Defined cases: null and empty texts have no words and lose none; a text of fewer
than ``width`` words keeps all; rows repeated in full are repeats of each other;
rows with null doc_id are documents like others; other columns are ignored,
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._seq import Prefix, chunks, column_bytes, mix, spans_mask
from ._shared import Workspace
from .repeats import KEY, KEYS, PRINTS, compact, covered, find, finish, keyed, list_column, mark_of, numbers, symbols_of, with_ranges

WIDTH = 35
GRAM = 12


def _edges(width: int, prints):
    """Opens paths into their edges."""

    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            at, entries = list_column(batch, "paths")
            first, last = numbers(entries, "first"), numbers(entries, "last")
            gram = np.asarray(entries.field("gram"))
            alone = np.asarray(entries.field("alone").cast(pa.int8()))
            for i, j in chunks(offsets):
                mine = np.flatnonzero((at >= i) & (at < j))
                if not len(mine):
                    continue
                symbols, bounds, _ = symbols_of("word", buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], prints)
                prefix = Prefix(symbols)
                n = last[mine] - first[mine] + 1
                row = np.repeat(mine, n)
                place = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = bounds[at[row] - i] + place
                who = pa.array(at[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(who), batch.column("mark").take(who), pa.array(place.astype(np.int32)), pa.array(gram[row]), pa.array(mix(prefix.of(start, start + width)).view(np.int64)), pa.array(alone[row].astype(bool))],
                    names=["doc_id", "mark", "place", "gram", "edge", "alone"],
                )

    return run


def branch_spans(edges: DataFrame, work: Workspace, prints) -> DataFrame:
    """KEY, first, last, path: runs of opened edges that occur in another run
    too, with the run where they do."""
    own = F.struct(*KEY, "place")
    twice = edges.groupBy("gram", "edge").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("low"), F.max(own).alias("high")).where("n > 1").drop("n")
    twice = work.keep(twice, "edges-twice")
    # the source of an edge is its least occurrence, and of that one the greatest
    met = edges.where("alone").join(twice, ["gram", "edge"]).withColumn("source", F.when(own.eqNullSafe(F.col("low")), F.col("high")).otherwise(F.col("low")))
    met = met.select(*KEY, "place", F.col("source.doc_id").alias("s_doc"), F.col("source.mark").alias("s_mark"), (F.col("place") - F.col("source.place")).alias("shift"))
    same = [*KEY, "s_doc", "s_mark", "shift"]
    island = F.col("place") - F.row_number().over(W.partitionBy(*same).orderBy("place"))
    runs = met.withColumn("island", island).groupBy(*same, "island").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    named = work.keep(runs.withColumn("path", F.xxhash64(F.lit(prints[0]), "s_doc", "s_mark", F.col("first") - F.col("shift"), F.col("last") - F.col("first"), F.lit("run"))), "runs")
    sources = named.select(F.col("s_doc").alias("doc_id"), F.col("s_mark").alias("mark"), (F.col("first") - F.col("shift")).alias("first"), (F.col("last") - F.col("shift")).alias("last"), "path")
    return named.select(*KEY, "first", "last", "path").unionByName(sources.distinct())


def repeated_spans(texts: DataFrame, work: Workspace, width: int = WIDTH, gram: int = GRAM, prints=PRINTS) -> DataFrame:
    """KEY, first, last, path: windows of texts whose words occur elsewhere too."""
    found = find(texts, work, "word", width, gram, prints=prints)
    opened = with_ranges(texts, found.open, ["first", "last", "gram", "alone"], "paths", "inner")
    edges = work.keep(opened.mapInArrow(_edges(width, prints), f"{KEYS}, place int, gram long, edge long, alone boolean"), "edges")
    spans = compact(found.known, work).unionByName(branch_spans(edges, work, prints))
    spans = work.keep(spans, "spans")
    for done in ("known", "open", "edges", "edges-twice", "runs", "paths"):
        work.drop(done)
    return spans


def _cut(width: int, with_text: bool):
    """A row for each text, and one for each place of a path, with its words."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("path", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            at, entries = list_column(batch, "spans")
            first, last, path = (numbers(entries, x) for x in ("first", "last", "path"))
            named = np.asarray(entries.field("path").is_valid())
            for i, j in chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                chunk = buf[offsets[i] : offsets[j]]
                _, bounds, (s, e) = symbols_of("word", chunk, own)
                gone = covered(i, j, bounds, width, at, first, last)
                text_of = np.repeat(np.arange(j - i), np.diff(bounds))
                kept, shas = _joined(chunk, s, e, ~gone, bounds)
                columns = [batch.column("doc_id").slice(i, j - i), batch.column("mark").slice(i, j - i), pa.array(np.diff(bounds)), pa.array(np.bincount(text_of[gone], minlength=j - i)), pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in shas])]
                columns.append(pa.array(_texts(chunk, own, s, text_of, gone) if with_text else [None] * (j - i), pa.string()))
                nulls = [pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *nulls], schema)], schema=schema)
                mine = np.flatnonzero(named & (at >= i) & (at < j))
                if len(mine):
                    start = bounds[at[mine] - i] + first[mine]
                    words, ranges = _joined(chunk, s, e, np.ones(len(s), bool), np.array([0, len(s)]), start, start + last[mine] - first[mine] + width)
                    nothing = pa.nulls(len(mine), pa.int64())
                    texts = pa.nulls(len(mine), pa.string())
                    yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, texts, texts, pa.array(path[mine]), pa.array([words[a:b] for a, b in ranges], pa.binary())], schema=schema)

    return run


def _joined(chunk, s, e, stay, bounds, start=None, end=None):
    """The words that stay, each followed by one space, and the ranges of them
    that hold each text (or the words from start to end), less the last space."""
    size = (e - s + 1) * stay
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(total[-1]), 0x20, np.uint8)
    if len(out):
        letters = np.ones(len(out), bool)
        letters[total[1:][stay] - 1] = False
        out[letters] = chunk[spans_mask(len(chunk), s[stay], e[stay])]
    a, b = (total[bounds[:-1]], total[bounds[1:]]) if start is None else (total[start], total[end])
    return out.tobytes(), [(x, max(x, y - 1)) for x, y in zip(a.tolist(), b.tolist())]


def _texts(chunk, own, s, text_of, gone) -> list[str]:
    """Texts without the bytes from the start of a cut word to the start of the
    next word."""
    following = np.minimum(np.append(s[1:], len(chunk)), own[1:][text_of])
    keep = ~spans_mask(len(chunk), s[gone], following[gone])
    left = np.concatenate([[0], np.cumsum(keep)])[own]
    rest = chunk[keep].tobytes()
    return [rest[a:b].decode("utf-8", "replace") for a, b in zip(left[:-1], left[1:])]


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = True, prints=PRINTS) -> DataFrame:
    """doc_id, mark, n_words, n_removed, kept_sha256 and, if asked for, text
    without the cut words (white space between kept words as it was)."""
    texts = keyed(docs)
    schema = f"{KEYS}, n_words long, n_removed long, kept_sha256 string, text string, path long, content binary"

    def search(prints):
        work = Workspace(docs.sparkSession)
        spans = repeated_spans(texts, work, width, gram, prints)
        rows = work.keep(with_ranges(texts, spans, ["first", "last", "path"], "spans", "left").mapInArrow(_cut(width, with_text), schema), "cut")
        work.drop("spans")
        return rows.where("n_words is not null").drop("path", "content"), rows.where("path is not null").select("path", "content")

    found = finish(search, prints)
    return found if with_text else found.drop("text")


def cut_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the words of passages that occur elsewhere too,
    and ``n_chars``, if there is one, to fit.  A text that loses nothing, a null
    included, stays as it was."""
    cut = dedup_substrings(docs).where("n_removed > 0").select("doc_id", "mark", F.col("text").alias("_cut")).dropDuplicates(KEY)
    own = docs.withColumn("_mark", mark_of(F.col("text")))
    on = own["doc_id"].cast("long").eqNullSafe(cut["doc_id"]) & (own["_mark"] == cut["mark"])
    met = own.join(cut, on, "left")
    text = F.coalesce(F.col("_cut"), own["text"])
    new = {"text": text, "n_chars": F.when(F.col("_cut").isNull(), own["n_chars"]).otherwise(F.length("_cut").cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return met.select(*(new[c].alias(c) if c in new else own[c] for c in docs.columns))
