"""Suffix-array deduplication over bytes.

Every 200-byte window that occurs twice has the same minimiser in both places
(`repeats`), so only suffixes that start at minimisers need sorting: a sparse
suffix array.  The open extents of one minimiser meet in a task, which sorts
them twice by mergesort, once as suffixes to the right of the minimiser and once
as reversed prefixes to the left of it.  Two suffixes are compared through
prefix polynomial hashes and binary search for their common extension, so a
comparison takes logarithmic time; the extension between neighbours of the
finished order is then compared byte by byte, and a hash collision makes the
task sort that batch by its bytes.  A window that begins ``o`` bytes before the
minimiser repeats exactly if another extent is in its class in both orders, at
least ``o`` deep on the left and ``200 - o`` on the right.

A minimiser with very many classes is dealt to several tasks.  What such a task
can't match in its own part is matched across parts by window fingerprint.

Whole extents that occur twice need no sorting; they, and what is matched across
parts, are proven at their source coordinates: the bytes of all places of a path
(`repeats.compact`) are brought together and compared, and if any differ, the
search starts again under other fingerprints.

Defined cases: null text is empty; texts shorter than the window keep all bytes;
rows repeated in full are repeats of each other; cuts may split a UTF-8
character, so the remaining bytes are given as binary; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._seq import U64, Prefix, alphabet, chunks, column_bytes, mix
from ._shared import Workspace
from .repeats import KEY, KEYS, PRINTS, compact, covered, find, finish, keyed, list_column, numbers, weaken, with_ranges

WIDTH = 200
GRAM = 32
#: Bytes of extents that a task sorts at a time.
SORT_BYTES = 4 << 20


class Suffixes:
    """Suffixes (or, with step -1, reversed prefixes) from ``start`` on, at most
    ``length`` bytes each."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, step: int, prefix: Prefix):
        self.buf, self.start, self.length, self.step, self.prefix = buf, start, length, step, prefix

    def _equal(self, i, j, m):
        a, b = self.start[i], self.start[j]
        if self.step > 0:
            return self.prefix.of(a, a + m) == self.prefix.of(b, b + m)
        return self.prefix.of(a - m, a) == self.prefix.of(b - m, b)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search on prefix hashes."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.length[i], self.length[j])
        while (go := low < high).any():
            half = (low + high + 1) >> 1
            same = self._equal(i, j, half)
            low = np.where(same, half, low)
            high = np.where(same | ~go, high, half - 1)
        return low

    def _byte(self, i, m):
        return self.buf[self.start[i] + m] if self.step > 0 else self.buf[self.start[i] - m - 1]

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m = self.common(i, j)
        ended_i, ended_j = m >= self.length[i], m >= self.length[j]
        out = ended_i & ~ended_j
        on = np.flatnonzero(~ended_i & ~ended_j)
        out[on] = self._byte(i[on], m[on]) < self._byte(j[on], m[on])
        return out

    def content(self, i: int) -> bytes:
        a, n = int(self.start[i]), int(self.length[i])
        return self.buf[a : a + n].tobytes() if self.step > 0 else self.buf[a - n : a][::-1].tobytes()

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by (group, suffix), and the common extension of each with the
        one before it (-1 for the first of a group); group is ascending."""
        n = len(group)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.arange(n)
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(heads, n))
        head = np.repeat(heads, sizes)
        end = head + np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max():
            place = np.arange(n)
            block = head + (place - head) // (2 * width) * (2 * width)
            middle = np.minimum(block + width, end)
            stop = np.minimum(block + 2 * width, end)
            at = np.flatnonzero(middle < stop)  # only where two runs meet
            left = place[at] < middle[at]
            low, high = np.where(left, middle[at], block[at]), np.where(left, stop[at], middle[at])
            own = order[at]
            base = low.copy()
            while len(go := np.flatnonzero(low < high)):
                half = (low[go] + high[go]) >> 1
                other, mine, is_left = order[half], own[go], left[go]
                lesser = self.less(np.where(is_left, other, mine), np.where(is_left, mine, other))
                before = np.where(is_left, lesser, ~lesser)  # the run on the left goes first among equals
                low[go] = np.where(before, half + 1, low[go])
                high[go] = np.where(before, high[go], half)
            to = block[at] + (at - np.where(left, block[at], middle[at])) + (low - base)
            order[to] = own
            width *= 2
        extension = np.full(n, -1, np.int64)
        inner = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        extension[inner] = self.common(order[inner - 1], order[inner])
        if not self._verified(order, extension, inner):
            order = np.array(sorted(range(n), key=lambda i: (group[i], self.content(i))), np.int64)
            for r in inner:
                a, b = self.content(order[r - 1]), self.content(order[r])
                extension[r] = next((m for m in range(min(len(a), len(b))) if a[m] != b[m]), min(len(a), len(b)))
        return order, extension

    def _verified(self, order, extension, inner) -> bool:
        """Compares what the hashes call common, byte by byte."""
        for part in np.array_split(inner, max(1, len(inner) // 20_000)):
            m = extension[part]
            offset = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            if self.step < 0:
                offset = -1 - offset
            a, b = np.repeat(self.start[order[part - 1]], m), np.repeat(self.start[order[part]], m)
            if not np.array_equal(self.buf[a + offset], self.buf[b + offset]):
                return False
        return True


def _extent_bytes(width: int, k: int):
    """Adds to each open extent its bytes."""

    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            at, entries = list_column(batch, "extents")
            if not len(at):
                continue
            first, last = numbers(entries, "first"), numbers(entries, "last")
            start = offsets[at] + first
            size = last - first + width
            for part in np.array_split(np.arange(len(at)), max(1, int(size.sum()) // (8 << 20))):
                data = [buf[a : a + n].tobytes() for a, n in zip(start[part], size[part])]
                who, take = pa.array(at[part]), pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(who), batch.column("mark").take(who), *(entries.field(x).take(take) for x in ("first", "last", "gram", "alone", "parts", "part")), pa.array(data, pa.binary())],
                    names=["doc_id", "mark", "first", "last", "gram", "alone", "parts", "part", "bytes"],
                )

    return run


def _anchors(prefix: Prefix, start: np.ndarray, last: np.ndarray, gram: np.ndarray, first: np.ndarray, width: int, k: int) -> np.ndarray:
    """Where each extent's minimiser stands: the first k-gram of that
    fingerprint that all its windows hold."""
    grams = mix(prefix.grams(k)).view(np.int64)
    at = start + (last - first)
    reach = width - k - (last - first)
    left = np.arange(len(at))
    while len(left):
        on = (grams[at[left]] != gram[left]) & (reach[left] > 0)
        left = left[on]
        at[left] += 1
        reach[left] -= 1
    return at


def _runs(member: np.ndarray, place: np.ndarray):
    """Maximal runs of consecutive places of each member."""
    if not len(member):
        return member, place, place
    order = np.lexsort((place, member))
    member, place = member[order], place[order]
    new = np.ones(len(member), bool)
    new[1:] = (member[1:] != member[:-1]) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(new)
    return member[heads], place[heads], place[np.append(heads[1:], len(member)) - 1]


def _sort_rows(t: pa.Table, width: int, k: int, prints=PRINTS):
    """Windows of the open extents that repeat, and those that other parts may
    hold.  t is ordered by gram and part."""
    buf, offsets = column_bytes(pa.array(t.column("bytes").combine_chunks()).cast(pa.large_binary()).view(pa.large_string()))
    first, last = np.asarray(t.column("first")).astype(np.int64), np.asarray(t.column("last")).astype(np.int64)
    gram, part = np.asarray(t.column("gram")), np.asarray(t.column("part"))
    alone, split = np.asarray(t.column("alone").cast(pa.int8())) > 0, np.asarray(t.column("parts")) > 1
    n = len(first)
    start, stop = offsets[:-1], offsets[1:]
    prefix = Prefix(weaken(alphabet(prints[0]), prints[1])[buf])
    anchor = _anchors(prefix, start, last, gram, first, width, k)
    group = np.cumsum(np.append(0, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])))
    rank, starts = [], []
    for suffixes in (Suffixes(buf, anchor, stop - anchor, 1, prefix), Suffixes(buf, anchor, anchor - start, -1, prefix)):
        order, extension = suffixes.sort(group)
        inverse = np.empty(n, np.int64)
        inverse[order] = np.arange(n)
        rank.append(inverse)
        starts.append(extension)
    place = np.arange(n)
    deepest, shallowest = anchor - start, anchor - start - (last - first)
    done_member, done_place, open_member, open_place, open_alone = [], [], [], [], []
    for o in range(int(max(0, shallowest.min())), int(deepest.max()) + 1):
        on = np.flatnonzero((shallowest <= o) & (o <= deepest))
        if not len(on):
            continue
        right = np.maximum.accumulate(np.where(starts[0] < width - o, place, 0))[rank[0][on]]
        left = np.maximum.accumulate(np.where(starts[1] < max(o, 0), place, 0))[rank[1][on]]
        _, head, inverse, count = np.unique(right * n + left, return_index=True, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        hit = on[twice & alone[on]]
        done_member.append(hit)
        done_place.append(anchor[hit] - o - start[hit] + first[hit])
        if split.any():
            # one window of each class of this part, with whether it still waits for a match
            rest = head[split[on[head]]]
            open_member.append(on[rest])
            open_place.append(anchor[on[rest]] - o - start[on[rest]] + first[on[rest]])
            open_alone.append((count[inverse[rest]] == 1) & alone[on[rest]])

    def rows(member, a, b, key, waits, known):
        who = pa.array(member)
        return pa.RecordBatch.from_arrays(
            [t.column("doc_id").combine_chunks().take(who), t.column("mark").combine_chunks().take(who), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(gram[member]), pa.array(key), pa.array(waits), pa.array(np.full(len(member), known))],
            names=["doc_id", "mark", "first", "last", "gram", "window", "waits", "known"],
        )

    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    member, a, b = _runs(join(done_member), join(done_place))
    yield rows(member, a, b, np.zeros(len(member), np.int64), np.zeros(len(member), bool), True)
    member, at = join(open_member), join(open_place)
    if len(member):
        s = start[member] + at - first[member]
        yield rows(member, at, at, mix(prefix.of(s, s + width)).view(np.int64), join(open_alone).astype(bool), False)


def _sort_parts(width: int, k: int, most: int, prints=PRINTS):
    """Reads rows ordered by gram and part, and sorts some groups at a time."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            t = pa.Table.from_batches(held)
            gram, part = np.asarray(t.column("gram")), np.asarray(t.column("part"))
            cut = np.flatnonzero((gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))
            if len(cut):
                yield from _sort_rows(t.slice(0, cut[-1] + 1), width, k, prints)
                rest = t.slice(cut[-1] + 1)
                held, size = rest.to_batches(), rest.nbytes
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                yield from _sort_rows(t, width, k, prints)

    return run


def repeated_spans(texts: DataFrame, work: Workspace, width: int = WIDTH, gram: int = GRAM, most: int = 20_000, prints=PRINTS) -> DataFrame:
    """KEY, first, last, path: windows of texts whose bytes occur elsewhere too.
    Those without path were compared byte by byte when they were sorted."""
    spark = texts.sparkSession
    found = find(texts, work, "byte", width, gram, most, prints)
    extents = with_ranges(texts, found.open, ["first", "last", "gram", "alone", "parts", "part"], "extents", "inner")
    schema = f"{KEYS}, first int, last int, gram long, alone boolean, parts int, part int, bytes binary"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.open.count() * (2 * width) // (4 * SORT_BYTES))
    dealt = extents.mapInArrow(_extent_bytes(width, gram), schema).repartition(tasks, "gram", "part").sortWithinPartitions("gram", "part")
    sorted_ = work.keep(dealt.mapInArrow(_sort_parts(width, gram, SORT_BYTES, prints), f"{KEYS}, first int, last int, gram long, window long, waits boolean, known boolean"), "sorted")
    across = sorted_.where("not known")
    twice = work.keep(across.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n"), F.max("waits").alias("waits")).where("n > 1 and waits").select("gram", "window"), "twice")
    matched = across.join(twice, ["gram", "window"], "left_semi").withColumn("path", F.xxhash64(F.lit(prints[0]), "gram", "window", F.lit("window")))
    spans = compact(found.known, work).unionByName(matched.select(*KEY, "first", "last", "path"))
    spans = work.keep(spans.unionByName(sorted_.where("known").select(*KEY, "first", "last", F.lit(None).cast("long").alias("path"))), "spans")
    for done in ("known", "open", "sorted", "twice", "paths"):
        work.drop(done)
    return spans


def _cut(width: int, with_bytes: bool):
    """A row for each text, and one for each place of a path, with its bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("path", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            at, entries = list_column(batch, "spans")
            first, last, path = (numbers(entries, x) for x in ("first", "last", "path"))
            named = np.asarray(entries.field("path").is_valid())
            for i, j in chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                chunk = buf[offsets[i] : offsets[j]]
                gone = covered(i, j, own, width, at, first, last)
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                inner = own[:-1][own[:-1] < len(gone)]
                head[inner] = gone[inner]
                total = lambda x: np.concatenate([[0], np.cumsum(x)])[own]
                left = total(~gone).tolist()
                kept = chunk[~gone].tobytes()
                rest = [kept[a:b] for a, b in zip(left[:-1], left[1:])]
                columns = [batch.column("doc_id").slice(i, j - i), batch.column("mark").slice(i, j - i), pa.array(np.diff(own)), pa.array(np.diff(total(gone))), pa.array(np.diff(total(head))), pa.array([hashlib.sha256(x).hexdigest() for x in rest])]
                columns += [pa.array(rest if with_bytes else [None] * (j - i), pa.binary()), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
                mine = np.flatnonzero(named & (at >= i) & (at < j))
                if len(mine):
                    start = own[at[mine] - i] + first[mine]
                    data = [chunk[a:b].tobytes() for a, b in zip(start, start + last[mine] - first[mine] + width)]
                    numbers_ = pa.nulls(len(mine), pa.int64())
                    yield pa.RecordBatch.from_arrays([*[numbers_] * 5, pa.nulls(len(mine), pa.string()), pa.nulls(len(mine), pa.binary()), pa.array(path[mine]), pa.array(data, pa.binary())], schema=schema)

    return run


def dedup_suffixes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = 20_000, with_bytes: bool = True, prints=PRINTS) -> DataFrame:
    """doc_id, mark, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    the remaining bytes (kept).  ``most``: open classes of one minimiser for one task."""
    texts = keyed(docs)
    schema = f"{KEYS}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, path long, content binary"

    def search(prints):
        work = Workspace(docs.sparkSession)
        spans = repeated_spans(texts, work, width, gram, most, prints)
        rows = work.keep(with_ranges(texts, spans, ["first", "last", "path"], "spans", "left").mapInArrow(_cut(width, with_bytes), schema), "cut")
        work.drop("spans")
        return rows.where("n_bytes is not null").drop("path", "content"), rows.where("path is not null").select("path", "content")

    found = finish(search, prints)
    return found if with_bytes else found.drop("kept")
