"""Exact deduplication through an extendible-hash index on shared files.

DataFrame functions only.  A text is addressed by the leading bits of a 64-bit
hash.  The directory starts with the slots that the number of hashes asks for
and is doubled until no bucket holds more than ``capacity`` of them: a bucket
that is overfull is split by one bit more, one that is not keeps its local depth
and is shared by several slots.  Only texts with the same 64 bits can't be told
apart so; they share an entry of their bucket as a chain.

Rows are dealt to owners by directory slot, so an owner holds a range of hashes.
It puts each text into the chain of its hash by comparing bytes, and writes the
bucket: an entry for each row, with what its group comes to.  The answer is read
from these files.

Texts that very many rows hold (at most ``HOT`` of them can exist) are folded a
few hundred rows at a time before they are dealt, so an owner gets few rows of
them; their rows then look their group up in the index, by slot, hash and digest.

Defined cases: null text is empty; the row with the largest doc_id of equal
texts stays; a null doc_id is kept only where no row of the group has another,
and rows repeated in full, id included, are kept together; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Workspace, bare_documents

#: Hashes that a bucket holds at most.
CAPACITY = 2048
#: A hash is hot if more than 1 / HOT of all rows, and SALTS rows, have it: so
#: there are fewer than HOT hot hashes (8 bytes each), which are broadcast.
HOT = 100_000
#: Rows of a hot text are folded into so many at most.
SALTS = 64
#: A directory of so many slots at most (24 bytes each) is broadcast.
BROADCAST_SLOTS = 1 << 16
#: Owner tasks at most, where the directory asks for more than the session has.
OWNERS = 1 << 16


def leading(h: Column, depth) -> Column:
    """The leading ``depth`` bits of a 64-bit number."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (64 - depth).cast("int")))


def directory(hashes: DataFrame, work: Workspace, capacity: int) -> tuple[DataFrame, int]:
    """slot, local_depth, bucket (the leading bits of its hashes), entries: one
    row for each slot that is not empty; and the depth."""
    n = hashes.count()
    depth = min(64, max(0, math.ceil(math.log2(max(1, n) / capacity))) + 1)
    while True:
        slots = hashes.groupBy(leading(F.col("hash"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        slots = work.keep(slots, f"slots-{depth}")
        # the prefixes of a slot, from the whole directory down to the slot itself
        shift = (depth - F.col("d")).cast("int")
        prefix = F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("slot"), shift))
        held = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("bucket", prefix)
        sizes = held.groupBy("d", "bucket").agg(F.sum("n").alias("entries"))
        fits = held.select("slot", "d", "bucket").join(sizes.where(F.col("entries") <= capacity), ["d", "bucket"])
        first = fits.groupBy("slot").agg(F.min_by(F.struct(F.col("d").alias("local_depth"), "bucket", "entries"), "d").alias("b"))
        whole = slots.join(first, "slot", "left").select("slot", "n", "b.*")
        if depth == 64 or whole.where("bucket is null").isEmpty():
            # with all 64 bits, what is left of a bucket is one hash
            return work.keep(whole.select("slot", F.coalesce("local_depth", F.lit(depth)).alias("local_depth"), F.coalesce("bucket", "slot").alias("bucket"), F.coalesce("entries", "n").alias("entries")), "directory"), depth
        depth = min(64, depth + 1)


def build_index(docs: DataFrame, work: Workspace, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index: bucket, local_depth, slot, hash, chain, digest, doc_id, n (rows
    that it stands for), hot, keep_id, group_size; the hot hashes; the depth."""
    texts = bare_documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    hashes = work.keep(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hashes")
    rows = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(hashes.where(F.col("n") > max(SALTS, rows / HOT)).select("hash"))
    slots, depth = directory(hashes, work, capacity)
    cold = texts.join(hot, "hash", "left_anti").select("hash", "text", "doc_id", F.lit(1).cast("long").alias("n"), F.lit(False).alias("hot"))
    salted = texts.join(hot, "hash", "left_semi").groupBy("hash", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    folded = salted.agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("hash", "text", "doc_id", "n", F.lit(True).alias("hot"))
    dealt = cold.unionByName(folded).withColumn("slot", leading(F.col("hash"), depth))
    n = slots.count()
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(OWNERS, n // 2))
    owned = dealt.repartition(owners, "slot")
    small = n <= BROADCAST_SLOTS
    placed = owned.join(F.broadcast(slots) if small else slots, "slot")
    # the chain of a hash: its texts in the order of their bytes, equal ones in one place
    same = W.partitionBy("slot", "hash", "text")
    chained = placed.withColumns({
        "chain": F.dense_rank().over(W.partitionBy("slot", "hash").orderBy("text")),
        "keep_id": F.max("doc_id").over(same),
        "group_size": F.sum("n").over(same),
    })
    index = chained.select("bucket", "local_depth", "slot", "hash", "chain", F.sha2("text", 256).alias("digest"), "doc_id", "n", "hot", "keep_id", "group_size")
    return work.keep(index, "index"), hot, depth


def dedup_exact(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row."""
    index, hot, depth = build_index(docs, Workspace(docs.sparkSession), capacity)
    text = F.coalesce("text", F.lit(""))
    probes = bare_documents(docs).select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).join(hot, "hash", "left_semi")
    probes = probes.select("doc_id", "hash", leading(F.col("hash"), depth).alias("slot"), F.sha2("text", 256).alias("digest"))
    # fewer than HOT hot hashes, so as few groups, unless hashes collide
    groups = index.where("hot").select("slot", "hash", "digest", "keep_id", "group_size").distinct()
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    found = index.where("not hot").select(*columns).unionByName(probes.join(F.broadcast(groups), ["slot", "hash", "digest"]).select(*columns))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
