"""Near-duplicate detection by one-permutation MinHash.

A text's set is its distinct 5-word shingles.  Equal sets (by a 128-bit digest of
the whole set) are folded into one class first, so thousands of copies are one
member.  A class gets a
one-permutation sketch, densified so that empty bins borrow from bins that a
universal hash names, and a key for each band of it.  Classes with a common key
share a bucket, and a bucket gives star-shaped candidate edges only: its least
member with each other member.  Edges are confirmed on the full sets.

A star can miss the link of two members that both differ from its centre.  So
after the confirmed links have been joined into components, each bucket that
still holds more than one component has all its pairs across components compared
too, on full sets, by a task that gives at most one link fewer than it has
members; a bucket of more than ``block`` members, or of more than ``WEIGHT``
shingles, is dealt out by pairs of blocks.

Two sets of similarity s share no band with probability (1 - s**6)**42, which is
0.0002 at s = 0.75 and below 1e-8 at 0.85.

Defined cases: null and empty texts have no shingles and are linked with nothing;
a text of one to four words has one shingle, all its words; rows that share a
doc_id are texts of one document, each with its own set, and links of any of them
are links of the document; a row without doc_id is linked with nothing, has no
component_id and is kept; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._seq import chunks, column_bytes, mix
from ._shared import Workspace, bare_documents, tune
from ._shingles import band_keys, one_permutation, shingle_sets
from .components import components

SHINGLE = 5
BINS = 256
ROWS = 6
BLOCK = 1024
#: Shingles of a block (8 bytes each), on average.
WEIGHT = 1 << 20
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75


def _digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of each set."""
    data = b"".join(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:]))
    return np.frombuffer(data, np.int64).reshape(-1, 2).T


def _sketches(size: int, bins: int, rows: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                values, first = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                n = np.diff(first)
                keys = band_keys(one_permutation(values, first, bins), rows)
                prints = _digests(values, first)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), bands], names=["doc_id", "n_shingles", "print1", "print2", "bands"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                values, first = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                prints = _digests(values, first)
                data = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(prints[0]), pa.array(prints[1]), pa.array(data, pa.binary())], names=["rep", "print1", "print2", "shingles"])

    return run


def similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _star_links(docs, sets, percent):
    """The first member is the centre."""
    centre, sizes = sets[0], np.array([len(x) for x in sets])
    if not len(centre):
        return
    rest = np.concatenate(sets[1:]) if len(sets) > 1 else centre[:0]
    hit = centre[np.minimum(np.searchsorted(centre, rest), len(centre) - 1)] == rest
    common = np.bincount(np.repeat(np.arange(len(sets) - 1), sizes[1:])[hit], minlength=len(sets) - 1)
    for i in np.flatnonzero(similar(common, len(centre), sizes[1:], percent)):
        yield docs[0], docs[i + 1]


def _cross_links(docs, sets, groups, percent):
    """Links across components; once a link has joined two, their other pairs
    need no look."""
    sizes = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    member, column = member[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for low in range(0, int(column.max()) + 1 if len(column) else 0, step):
        on = (column >= low) & (column < low + step)
        held = np.zeros((len(sets), step), np.float32)
        held[member[on], column[on] - low] = 1
        common += held @ held.T
    common = common.astype(np.int64)
    linked = np.triu(similar(common, sizes[:, None], sizes[None, :], percent), 1)
    parent = {g: g for g in groups}

    def top(g):
        while parent[g] != g:
            parent[g] = g = parent[parent[g]]
        return g

    for i, j in zip(*np.nonzero(linked)):
        a, b = top(groups[i]), top(groups[j])
        if a != b:
            parent[a] = b
            yield docs[i], docs[j]


def _verify(star: bool, percent: int):
    """Reads rows ordered by unit, and confirms the links of one unit at a time."""

    def links(rows):
        rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: (not r[2], r[0]))
        docs = [r[0] for r in rows]
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        if star:
            return list(_star_links(docs, sets, percent)) if rows[0][2] else []
        return list(_cross_links(docs, sets, [r[1] for r in rows], percent)) if len(rows) > 1 else []

    def run(batches):
        unit, held, out = None, [], []
        for batch in batches:
            units = list(zip(*(batch.column(x).to_pylist() for x in ("key", "part", "other"))))
            columns = [batch.column(x).to_pylist() for x in ("class", "component", "centre", "shingles")]
            for u, *row in zip(units, *columns):
                if u != unit and held:
                    out += links(held)
                    held = []
                unit = u
                held.append(row)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if held:
            out += links(held)
        yield _pairs(out)

    return run


def _pairs(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _confirm(units: DataFrame, sets: DataFrame, star: bool, percent: int) -> DataFrame:
    """units: key, part, other, class, component, centre."""
    unit = ["key", "part", "other"]
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.join(sets, "class").repartition(max(tasks, units.count() // 4000), *unit).sortWithinPartitions(*unit)
    return dealt.select(*unit, "class", "component", "centre", "shingles").mapInArrow(_verify(star, percent), "a long, b long")


def link_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row."""
    tune(docs.sparkSession)
    work = Workspace(docs.sparkSession)
    texts = bare_documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketches = work.keep(texts.mapInArrow(_sketches(size, bins, rows), "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>"), "sketches")
    same = ["n_shingles", "print1", "print2"]
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    folded = usable.groupBy(*same).agg(F.min(F.struct("doc_id", "bands")).alias("at")).select(*same, F.col("at.doc_id").alias("rep"), "at.bands")
    # the number of a class is fixed by writing it
    classes = work.keep(folded.withColumn("class", F.monotonically_increasing_id()), "classes")
    keys = classes.select("class", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("class", "n")).alias("centre"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).where("members > 1")
    members = work.keep(keys.join(buckets, "key").select("key", "class", "n", "centre", "members", "weight"), "members")

    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select("rep", "print1", "print2", "class")
    # rows repeated in full are folded before their sets are made
    chosen = texts.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct()
    made = chosen.mapInArrow(_sets(size), "rep long, print1 long, print2 long, shingles binary")
    sets = work.keep(made.join(wanted, ["rep", "print1", "print2"]).select("class", "shingles"), "sets")

    # stars; sizes that differ too much can't reach the threshold
    edges = members.where((F.col("class") != F.col("centre.class")) & (100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))).select(F.col("centre.class").alias("key"), "class", "n").distinct()
    parts = lambda count, weight: F.ceil(F.greatest(count / F.lit(block), weight / F.lit(WEIGHT))).cast("int")
    spread = edges.groupBy("key").agg(parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    dealt = work.keep(edges.join(spread, "key").select("key", F.pmod(F.hash("class"), "parts").alias("part"), "class"), "edges")
    none = [F.lit(0).alias("other"), F.lit(0).cast("long").alias("component")]
    stars = dealt.select("key", "part", "class", *none, F.lit(False).alias("centre")).unionByName(dealt.select("key", "part").distinct().select("key", "part", F.col("key").alias("class"), *none, F.lit(True).alias("centre")))
    # the classes of one doc_id belong together
    several = usable.join(classes.select(*same, "class"), same).select("doc_id", "class").distinct()
    first = several.groupBy("doc_id").agg(F.min("class").alias("b"), F.max("class").alias("most")).where("b < most").select("doc_id", "b")
    own = several.join(first, "doc_id").select(F.col("class").alias("a"), "b").where("a <> b")
    links = work.keep(_confirm(stars, sets, True, percent).unionByName(own), "links")
    found = components(links, work, "stars")

    # buckets that still hold several components, each set of members once
    placed = members.join(found.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "members", "weight", F.coalesce("component", "class").alias("component"))
    placed = work.keep(placed, "placed")
    left = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("print"), F.max("members").alias("members")).where("low <> high")
    chosen = work.keep(left.groupBy("print", "members").agg(F.min("key").alias("key")).select("key"), "chosen")
    cross = placed.join(chosen, "key").withColumn("blocks", parts(F.col("members"), F.col("weight"))).withColumn("mine", F.pmod(F.hash("class"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one other block at a time; a block alone is its own unit
    units = work.keep(cross.select("key", F.least("mine", "with").alias("part"), F.greatest("mine", "with").alias("other"), "class", "component", F.lit(False).alias("centre")), "units")
    more = _confirm(units, sets, False, percent)
    joined = components(links.unionByName(more), work, "all")

    of_class = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = work.keep(of_class.join(least, "component").select(*same, "component_id"), "named")
    for done in ("members", "sets", "edges", "links", "placed", "chosen", "units", "classes"):
        work.drop(done)
    linked = usable.join(named, same).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
