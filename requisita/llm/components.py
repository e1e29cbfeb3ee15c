"""Connected components of a table of links, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm: each node links its larger
    (``large``) or its smaller neighbours to the least node it knows."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the least neighbour comes from a partial aggregate, so a hub costs a row a task
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, component (the least node reachable) for nodes that have a link."""
    edges = work.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before, step = tuple(now), step + 1
        after = work.keep(_star(_star(edges, True), False), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        edges = after
    # every node now points to its component's least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
