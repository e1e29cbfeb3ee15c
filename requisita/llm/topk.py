"""Exact top-k search by inner product, with a ball tree for each shard.

Candidates are dealt to shards, and a task holds one: it builds a ball tree over
its candidates and then reads the queries, some hundred at a time.  It goes down
the tree level by level for all of them at once: a node is dropped for a query
when its upper bound, ``q . centre + |q| * radius``, is below the query's current
kth score.  The leaves that are left are visited in the order of their bounds,
and the kth score rises meanwhile.  Each query first searches one pilot shard;
the kth score found there is shared with all other shards, which start from it.
Equal bounds are never dropped, since an equal score with a smaller id would win.

Candidates move once for the pilot and once for the rest, and queries once to
each shard, which an exact answer asks for.

Defined cases: vectors that are null, or hold a null or a component that is not
finite, take no part, nor do rows without vec_id; rows that share a vec_id are
candidates, and queries, of their own, and each other's candidates too; vectors
of different lengths have no product; ties go to the smaller vec_id; other
columns are ignored; an empty table gives an empty result.  Products that a
double can't hold exactly are taken as Python integers, and a score that does
not fit 64 bits is the nearest that does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Workspace, tune

K = 20
QUERY_MODULUS = 20
SCALE = 64.0
#: Components of the vectors of a shard (8 bytes each), on average.
SHARD_VALUES = 1 << 21
LEAF = 128
#: Sums of products below this are exact in a double.
_EXACT = float(1 << 53)
_NOTHING = np.int64(-(2**63) + 1)


class BallTree:
    """Nodes level by level.  A node's points are ``order[low:high]``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.low, self.high, self.children = [], [], [], [], []
        self.levels: list[list[int]] = []
        level = [(0, len(points))]
        while level:
            ids, below = [], []
            for low, high in level:
                own = points[self.order[low:high]]
                centre = own.mean(0)
                away = np.linalg.norm(own - centre, axis=1)
                node = len(self.low)
                ids.append(node)
                self.centre.append(centre)
                # the margin covers the rounding of centre and distance
                self.radius.append(float(away.max()) * (1 + 1e-9) + 1e-6)
                self.low.append(low)
                self.high.append(high)
                if high - low > leaf:
                    # split along the line from the farthest point to the one farthest from it
                    a = own[away.argmax()]
                    b = own[np.linalg.norm(own - a, axis=1).argmax()]
                    half = (high - low) // 2
                    side = np.argpartition(own @ (b - a), half)
                    self.order[low:high] = self.order[low:high][side]
                    below += [(low, low + half), (low + half, high)]
                    self.children.append(True)
                else:
                    self.children.append(False)
            self.levels.append(ids)
            level = below
        self.centre = np.array(self.centre)
        self.radius = np.array(self.radius)
        first, kids = 1, []
        for inner in self.children:
            kids.append((first, first + 1) if inner else ())
            first += 2 * inner
        self.kids = kids


def search(tree: BallTree, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, k: int):
    """Places (query, candidate, score) of each query's k best of this shard
    among those of at least its floor.  Higher scores go first, then smaller ids,
    then smaller rows."""
    n = len(points)
    order = np.lexsort((rows, ids))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)  # a smaller id is better
    norms = np.linalg.norm(queries, axis=1) * (1 + 1e-9)
    slack = 1e-6 * (1 + norms)
    best = np.full((len(queries), k), _NOTHING, np.int64)  # best first
    best_rank = np.full((len(queries), k), n, np.int64)

    def kth():
        return np.maximum(np.where(best_rank[:, -1] == n, -np.inf, best[:, -1].astype(np.float64)), floor)

    def visit(leaf: int, who: np.ndarray, limit: np.ndarray) -> None:
        own = tree.order[tree.low[leaf] : tree.high[leaf]]
        scores = np.rint(queries[who] @ points[own].T).astype(np.int64)
        ranks = np.broadcast_to(rank[own], scores.shape)
        out = (scores < limit[who][:, None]) | (rows[own][None, :] == query_rows[who][:, None])
        some = np.flatnonzero(~out.all(1))
        if not len(some):
            return
        at = who[some]
        scores = np.concatenate([best[at], np.where(out[some], _NOTHING, scores[some])], 1)
        ranks = np.concatenate([best_rank[at], np.where(out[some], n, ranks[some])], 1)
        top = np.lexsort((ranks, -scores), axis=1)[:, :k]
        best[at], best_rank[at] = np.take_along_axis(scores, top, 1), np.take_along_axis(ranks, top, 1)

    # a dive to the most promising leaf gives a first kth score
    at = np.zeros(len(queries), np.int64)
    while True:
        inner = np.flatnonzero([bool(tree.kids[x]) for x in at])
        if not len(inner):
            break
        for node in np.unique(at[inner]):
            who = inner[at[inner] == node]
            kids = np.array(tree.kids[node])
            at[who] = kids[(queries[who] @ tree.centre[kids].T + norms[who, None] * tree.radius[kids]).argmax(1)]
    dived = at
    limit = kth()
    for leaf in np.unique(dived):
        visit(int(leaf), np.flatnonzero(dived == leaf), limit)

    # branch and bound, a level at a time
    limit = kth()
    alive = {0: np.arange(len(queries))}
    leaves: list[tuple[int, np.ndarray, np.ndarray]] = []
    for level in tree.levels:
        for node in level:
            who = alive.pop(node, None)
            if who is None or not len(who):
                continue
            upper = queries[who] @ tree.centre[node] + norms[who] * tree.radius[node] + slack[who]
            on = upper >= limit[who]
            who, upper = who[on], upper[on]
            if tree.kids[node]:
                for kid in tree.kids[node]:
                    alive[kid] = who
            else:
                on = dived[who] != node
                leaves.append((node, who[on], upper[on]))
    if leaves:
        node = np.concatenate([np.full(len(w), x) for x, w, _ in leaves])
        who = np.concatenate([w for _, w, _ in leaves])
        upper = np.concatenate([u for _, _, u in leaves])
        by_bound = np.lexsort((-upper, who))
        node, who, upper = node[by_bound], who[by_bound], upper[by_bound]
        turn = np.arange(len(who)) - np.searchsorted(who, who, "left")
        # several turns at a time, so that one product serves many queries
        wave = turn // 4
        for w in range(int(wave.max()) + 1 if len(wave) else 0):
            limit = kth()
            on = np.flatnonzero((wave == w) & (upper >= limit[who]))
            on = on[np.argsort(node[on], kind="stable")]
            cuts = np.flatnonzero(np.diff(node[on])) + 1
            for group in np.split(on, cuts) if len(on) else []:
                visit(int(node[group[0]]), who[group], limit)
    q, at = np.nonzero(best_rank < n)
    return q, order[best_rank[q, at]], best[q, at]


def _search_plain(points, ids, rows, queries, query_rows, floor, k):
    """The same by Python integers, for products too large for exact floats."""
    whole = [[int(x) for x in p] for p in points]
    out = []
    for i, q in enumerate(queries):
        q = [int(x) for x in q]
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, p)))), int(ids[j]), int(rows[j]), j) for j, p in enumerate(whole) if rows[j] != query_rows[i]]
        out += [(i, j, -s) for s, _, _, j in sorted(scores)[:k] if -s >= floor[i]]
    return tuple(np.array([x[c] for x in out], np.int64) for c in range(3))


class _Shard:
    """One shard's candidates, and its tree, built when the first queries come."""

    def __init__(self, leaf: int):
        self.leaf, self.parts, self.tree = leaf, [], None

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(_arrays(batch))

    def ask(self, batch: pa.RecordBatch, k: int):
        if self.tree is None:
            self.vec, self.row, _, self.points = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 4
            self.parts = []
            self.largest = np.abs(self.points).max(initial=0)
            self.tree = BallTree(self.points, self.leaf) if len(self.points) and self.largest <= _EXACT else True
        ids, rows, floor, queries = _arrays(batch)
        if not len(self.points):
            return None
        exact = queries.shape[1] * self.largest * np.abs(queries).max(initial=0) < _EXACT
        if exact and self.tree is not True:
            q, c, s = search(self.tree, self.points, self.vec, self.row, queries, rows, floor, k)
        else:
            q, c, s = _search_plain(self.points, self.vec, self.row, queries, rows, floor, k)
        return pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(ids[q]), pa.array(self.vec[c]), pa.array(s)], names=["query_row", "query_id", "vec_id", "score"])


def _arrays(batch: pa.RecordBatch):
    ids, rows = np.asarray(batch.column("vec_id")), np.asarray(batch.column("row"))
    floor = np.asarray(batch.column("floor").fill_null(-np.inf))
    values = np.asarray(batch.column("vector").flatten()).astype(np.float64)
    return ids, rows, floor, values.reshape(len(ids), -1) if len(values) else np.zeros((len(ids), 0))


def _tasks(k: int, leaf: int):
    """Reads rows ordered by (shard, size, query): the candidates of a shard, then
    its queries, a batch of them at a time against the one tree."""

    def run(batches):
        shard, key = None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(x)).astype(np.int64) for x in ("shard", "size")] + [np.asarray(batch.column("query").cast(pa.int8())).astype(np.int64)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), keys.shape[1]]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if tuple(keys[:2, a]) != key:
                    shard, key = _Shard(leaf), tuple(keys[:2, a])
                part = batch.slice(a, b - a)
                if not keys[2, a]:
                    shard.add(part)
                elif (found := shard.ask(part, k)) is not None:
                    yield found

    return run


def top_k(vectors: DataFrame, k: int = K, modulus: int = QUERY_MODULUS, shard_values: int = SHARD_VALUES, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by
    ``modulus``, against all other rows.  Each such row is a query of its own."""
    spark = vectors.sparkSession
    tune(spark)
    work = Workspace(spark)
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(SCALE))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    floors = F.transform("vector", lambda x: x - F.pmod(x, F.lit(1.0)))  # floor as a double: no overflow
    # the number of a row is fixed by writing it
    rows = work.keep(usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", floors.alias("vector"), F.size("vector").alias("size")), "vectors")
    n, values = rows.agg(F.count(F.lit(1)), F.sum(F.greatest("size", F.lit(1)))).first()
    shards = max(math.ceil((values or 0) / shard_values), min(8, math.ceil(n / 1024)), 1)
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    asked = rows.where(F.col("vec_id") % modulus == 0)
    columns = ["shard", "size", "query", "row", "vec_id", "vector", "floor"]
    none = F.lit(None).cast("double")

    def run(queries: DataFrame) -> DataFrame:
        both = candidates.withColumn("query", F.lit(False)).withColumn("floor", none).select(*columns).unionByName(queries.withColumn("query", F.lit(True)).select(*columns))
        dealt = both.repartition(shards, "shard", "size").sortWithinPartitions("shard", "size", "query")
        return dealt.mapInArrow(_tasks(k, leaf), "query_row long, query_id long, vec_id long, score long")

    pilot = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(shards)).cast("int")
    found = work.keep(run(asked.withColumn("shard", pilot).withColumn("floor", none)), "pilot")
    if shards > 1:
        known = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).cast("double").alias("floor")).withColumnRenamed("query_row", "row")
        others = asked.join(known, "row", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != pilot)
        found = found.unionByName(run(others))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
