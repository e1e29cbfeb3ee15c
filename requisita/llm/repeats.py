"""Where do windows of ``width`` symbols repeat?  Common to suffix-array and
substring deduplication.

The windows of a text are bucketed by their minimiser (`_seq.Extents`), as
compacting de Bruijn assemblers bucket k-mers.  One row for each extent, not for
each window, is shuffled: about one in sixty bytes or ten words.

* an extent whose (gram, body) is seen twice: all its windows repeat;
* an extent whose gram is seen nowhere else: none of its windows repeats;
* the rest are *open*: other extents share the minimiser but not all symbols.
  Their windows are compared one by one, by the caller's method.

Repeated extents are then edges of a graph whose nodes are the places between
them.  An edge that is always followed by one and the same other edge, which
always follows it, is joined with that one (`compact`), so that a passage that
is copied as a whole is one *path*, however long.

All of this goes by fingerprints.  What they call equal is proven in the end:
`occurrences` gives the source coordinates of each path, the caller brings the
symbols that stand there, and `differ` compares them.  If any differ, the caller
searches again under other fingerprints.  Equal windows have equal fingerprints
under any, so a search that is proven has missed nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._seq import U64, Extents, alphabet, chunks, column_bytes, spans_mask, word_hashes, words
from ._shared import Workspace, bare_documents, tune

KEY = ["doc_id", "mark"]
KEYS = "doc_id long, mark long"
#: (seed, bits) of the fingerprints of symbols.  Fewer bits are for tests.
PRINTS = (0, 64)


def mark_of(text: Column) -> Column:
    """Tells rows of one doc_id (or of none) apart by their text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text.  Rows that are equal in both get equal results, and
    count as repeats of each other."""
    return bare_documents(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("mark", mark_of(F.col("text")))


def weaken(symbols: np.ndarray, bits: int) -> np.ndarray:
    return symbols if bits >= 64 else symbols & U64((1 << bits) - 1)


def symbols_of(unit: str, buf: np.ndarray, offsets: np.ndarray, prints=PRINTS):
    """Symbols and text bounds of a chunk: its bytes, or its words."""
    seed, bits = prints
    if unit == "byte":
        return weaken(alphabet(seed), bits)[buf], offsets, None
    s, e, first = words(buf, offsets)
    return weaken(word_hashes(buf, s, e, seed=seed), bits), first, (s, e)


class Content:
    """Compares ranges of symbols by what they are, not by fingerprints."""

    def __init__(self, buf: np.ndarray, places):
        if places is None:
            self.size, self.at, self.bytes = None, None, buf
        else:
            s, e = places
            self.size = e - s
            self.at = np.concatenate([[0], np.cumsum(self.size)])
            self.bytes = buf[spans_mask(len(buf), s, e)] if len(s) else buf[:0]

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Whether the n symbols from a on are those from b on, for many ranges."""
        out = np.ones(len(n), bool)
        for part in np.array_split(np.arange(len(n)), max(1, int(n.sum()) // most)):
            x, y, m = a[part], b[part], n[part]
            if self.size is not None:
                equal = _all_equal(self.size, x, y, m)
                out[part] = equal
                part, x, y, m = part[equal], x[equal], y[equal], m[equal]
                x, y, m = self.at[x], self.at[y], self.at[x + m] - self.at[x]
            out[part] &= _all_equal(self.bytes, x, y, m)
        return out


def _all_equal(values: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether values[a : a + n] and values[b : b + n] are the same; n > 0."""
    if not len(n):
        return np.zeros(0, bool)
    to = np.cumsum(n)
    within = np.arange(to[-1]) - np.repeat(to - n, n)
    return np.logical_and.reduceat(values[np.repeat(a, n) + within] == values[np.repeat(b, n) + within], to - n)


def _extent_rows(unit: str, width: int, k: int, prints) -> Callable:
    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                chunk = buf[offsets[i] : offsets[j]]
                symbols, bounds, places = symbols_of(unit, chunk, own, prints)
                x = Extents(symbols, bounds, width, k)
                if not len(x.first):
                    continue
                first, last = x.first - bounds[x.text], x.last - bounds[x.text]
                # equal extents of one text are one row; what they cover is known here already
                order = np.lexsort((first, x.body, x.gram, x.text))
                new = np.ones(len(order), bool)
                for a in (x.body, x.gram, x.text):
                    new[1:] &= a[order][1:] == a[order][:-1]
                new[1:], new[0] = ~new[1:], True
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(order)))
                apart = np.zeros(len(heads), bool)
                if (n > 1).any():
                    # what has equal fingerprints in one text is compared at once
                    group = np.repeat(np.arange(len(heads)), n)
                    rest = np.flatnonzero(~new)
                    a, b = order[heads[group[rest]]], order[rest]
                    size = last[a] - first[a]
                    alike = last[b] - first[b] == size
                    alike[alike] = Content(chunk, places).same(x.first[a[alike]], x.first[b[alike]], size[alike] + width)
                    apart[group[rest[~alike]]] = True
                folded = n * ~apart
                at = np.concatenate([order[heads[~apart]], order[np.repeat(apart, n)]])
                count = np.concatenate([n[~apart], np.ones(n[apart].sum(), np.int64)])
                yield _rows(batch, i + x.text[at], first[at], last[at], x.gram[at], x.body[at], count)
                again = np.repeat(folded > 1, n)
                if again.any():
                    more = np.sort(order[again])
                    t, f, l = x.text[more], first[more], last[more]
                    cut = np.ones(len(more), bool)
                    cut[1:] = (t[1:] != t[:-1]) | (f[1:] != l[:-1] + 1)
                    h = np.flatnonzero(cut)
                    z = np.zeros(len(h), np.int64)
                    yield _rows(batch, i + t[h], f[h], l[np.append(h[1:], len(more)) - 1], z.astype(U64), z.astype(U64), z)

    return run


def _rows(batch, at, first, last, gram, body, n) -> pa.RecordBatch:
    at = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(body.view(np.int64)), pa.array(n.astype(np.int32))],
        names=["doc_id", "mark", "first", "last", "gram", "body", "n"],
    )


@dataclass
class Repeats:
    """known: extents [first, last] of documents that repeat, with their class
    (null: compared already, within their text).  open: one extent of each class
    of the grams that have extents of one occurrence left; alone marks those,
    parts says how many parts a large gram is dealt to, part which."""

    known: DataFrame
    open: DataFrame


def find(texts: DataFrame, work: Workspace, unit: str, width: int, k: int, most: int = 20_000, prints=PRINTS) -> Repeats:
    """texts: of ``keyed``; most: classes of one gram that one task may get."""
    tune(texts.sparkSession)
    schema = f"{KEYS}, first int, last int, gram long, body long, n int"
    extents = work.keep(texts.mapInArrow(_extent_rows(unit, width, k, prints), schema), "extents")
    classed = extents.where("n > 0")
    # Partial aggregates come before the shuffle: a gram of a third of all rows costs a row a
    # task.  They are written, so that both sides of the joins are shuffles that AQE can split.
    grams = classed.groupBy("gram").agg(F.sum("n").alias("rows"), F.min("body").alias("least"), F.max("body").alias("most")).where("rows > 1")
    grams = work.keep(grams.select("gram", (F.col("least") != F.col("most")).alias("mixed")), "grams")
    shared = work.keep(classed.join(grams, "gram"), "shared-rows")
    # rows repeated in full have equal extents, which are one from here on
    once = shared.groupBy(*KEY, "first", "last", "gram", "body", "mixed").agg(F.sum("n").alias("n"))
    shared = work.keep(once.unionByName(extents.where("n = 0").distinct().withColumn("mixed", F.lit(False))), "shared")
    work.drop("shared-rows")
    work.drop("extents")
    mixed = shared.where("mixed")
    classes = work.keep(mixed.groupBy("gram", "body").agg(F.sum("n").alias("rows"), F.min(F.struct("doc_id", "mark", "first", "last")).alias("at")), "classes")
    open_grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.max(F.col("rows") == 1).alias("left")).where("left").select("gram", F.ceil(F.col("classes") / most).cast("int").alias("parts"))
    open_grams = work.keep(open_grams, "open-grams")
    opened = work.keep(
        classes.join(open_grams, "gram").select("at.*", "gram", (F.col("rows") == 1).alias("alone"), "parts", F.pmod(F.hash("body"), "parts").alias("part")),
        "open",
    )
    name = F.when(F.col("n") > 0, F.xxhash64(F.lit(prints[0]), "gram", "body")).alias("class")
    known = shared.where("not mixed").select(*KEY, "first", "last", name).unionByName(
        mixed.join(classes.where("rows > 1").select("gram", "body"), ["gram", "body"], "left_semi").select(*KEY, "first", "last", name)
    )
    known = work.keep(known, "known")
    for done in ("shared", "classes", "grams", "open-grams"):
        work.drop(done)
    return Repeats(known, opened)


def compact(known: DataFrame, work: Workspace) -> DataFrame:
    """KEY, first, last, path: known extents, joined along the paths that do not
    branch.

    Nodes are the ends of extents.  A node does not branch if all occurrences of
    the class that ends there go on with one class, and all of that class come
    from there: their numbers and the number of transitions are the same.  Such
    chains have no cycle, since the last occurrence in a text has none after it.
    Each class then finds the head of its chain by pointer doubling, in as many
    joins as the length of the longest chain has binary digits."""
    along = W.partitionBy(*KEY).orderBy("first")
    follows = F.lead("first").over(along) == F.col("last") + 1
    placed = work.keep(known.where("class is not null").withColumn("next", F.when(follows, F.lead("class").over(along))), "edges-placed")
    degree = work.keep(placed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("last") - F.col("first") + 1).cast("long").alias("size")), "degree")
    crossed = placed.where("next is not null").groupBy("class", "next").agg(F.count(F.lit(1)).alias("n"))
    out = crossed.join(degree, ["class", "n"]).join(degree.select(F.col("class").alias("next"), "n"), ["next", "n"])
    links = work.keep(out.select(F.col("next").alias("class"), F.col("class").alias("up"), F.col("size").alias("back")), "links")
    # a class that has no link up is the head of its chain
    chain, step = links.withColumn("done", F.lit(False)), 0
    while not chain.where("not done").isEmpty():
        over = chain.select(F.col("class").alias("up"), F.col("up").alias("up2"), F.col("back").alias("back2"))
        joined = chain.join(over, "up", "left")
        chain = work.keep(joined.select("class", F.coalesce("up2", "up").alias("up"), (F.col("back") + F.coalesce("back2", F.lit(0))).alias("back"), F.col("up2").isNull().alias("done")), f"chain-{step}")
        step += 1
    on = placed.join(chain.select("class", "up", "back"), "class", "left").select(*KEY, "first", "last", F.coalesce("up", "class").alias("path"), F.coalesce("back", F.lit(0)).alias("back"))
    spans = on.groupBy(*KEY, "path", (F.col("first") - F.col("back")).alias("start")).agg(F.min("first").alias("first"), F.max("last").alias("last")).select(*KEY, "first", "last", "path")
    spans = work.keep(spans.unionByName(known.where("class is null").select(*KEY, "first", "last", F.lit(None).cast("long").alias("path"))), "paths")
    for done in ("edges-placed", "degree", "links", *(f"chain-{i}" for i in range(step))):
        work.drop(done)
    return spans


def differ(occurrences: DataFrame) -> bool:
    """Whether the symbols of any two occurrences (path, content) of a path
    differ.  Equal ones fold before the shuffle, so a hot path costs a row a task."""
    variants = occurrences.groupBy("path", "content").agg(F.count(F.lit(1)).alias("n"))
    return not variants.groupBy("path").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").isEmpty()


def with_ranges(texts: DataFrame, ranges: DataFrame, columns: list[str], name: str, how: str) -> DataFrame:
    """Texts with an array of the ranges that lie in them.  Ranges are distinct,
    so an array is no longer than a small multiple of the text."""
    grouped = ranges.select(*KEY, *columns).distinct().groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias(name))
    on = texts["doc_id"].eqNullSafe(grouped["doc_id"]) & (texts["mark"] == grouped["mark"])
    return texts.join(grouped, on, how).select(texts["doc_id"], texts["mark"], texts["text"], grouped[name])


def list_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """Row of each entry, and the entries, of an array column (null: none)."""
    column = batch.column(name)
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def numbers(entries: pa.StructArray, name: str) -> np.ndarray:
    return np.asarray(entries.field(name).fill_null(0)).astype(np.int64)


def covered(i: int, j: int, bounds: np.ndarray, width: int, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of the symbols of texts i to j that a repeated window covers."""
    mine = (at >= i) & (at < j)
    start = bounds[at[mine] - i]
    return spans_mask(int(bounds[-1]), start + first[mine], start + last[mine] + width)


def finish(search: Callable, prints) -> DataFrame:
    """The result of ``search(prints)`` = (rows, occurrences), searched again
    under other fingerprints while occurrences of a path differ."""
    while True:
        rows, occurrences = search(prints)
        if not differ(occurrences):
            return rows
        prints = (prints[0] + 1, 64)
