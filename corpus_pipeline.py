"""A training corpus from raw documents: five stages, each of which reads what
the one before it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from requisita.llm._shared import Workspace, table
from requisita.llm.exact_dedup import dedup_exact
from requisita.llm.minhash_dedup import link_components
from requisita.llm.packing import pack_documents
from requisita.llm.quality import keep_good
from requisita.llm.substring_dedup import cut_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _name() -> Column:
    """A fingerprint of (doc_id, text): names a row where ids repeat or lack."""
    return F.xxhash64(F.col("doc_id").cast("long"), _text())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts, that with the largest doc_id; of rows
    with the same doc_id and text, the least by the other columns."""
    key = lambda sha: F.concat_ws(" ", sha, F.col("doc_id").cast("long").cast("string"))
    kept = dedup_exact(docs).where("kept").select(key(F.col("text_sha256")).alias("key")).distinct()
    # folded before the shuffle, and dealt by the key that the join needs too
    once = docs.groupBy(key(F.sha2(_text(), 256)).alias("key")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.join(kept, "key", "left_semi").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, that with the least doc_id.
    Texts that share a doc_id are documents of their own; rows without doc_id are
    linked with nothing and all stay."""
    named = docs.where("doc_id is not null").withColumn("name", _name())
    linked = link_components(named.select(F.col("name").alias("doc_id"), "text")).select(F.col("doc_id").alias("name"), "component_id")
    best = linked.join(named.select("name", "doc_id"), "name").groupBy("component_id").agg(F.min(F.struct("doc_id", "name")).alias("least"))
    found = named.join(best.select("least.name"), "name", "left_semi").select(*docs.columns)
    return found.unionByName(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur elsewhere too; a
    document that loses nothing keeps its text as it was, null included."""
    return cut_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: which words of which document go where."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("minhash_dedup", near), ("substring_dedup", substrings), ("packing", packing)]

#: A classifier and a similarity join over minima have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.keep(docs, f"{i}-{name}")
    return docs
