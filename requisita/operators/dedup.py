"""Copies of scanned documents: byte-identical, and scanned again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clean_id, to_number


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def physical_dedup(scan: DataFrame) -> DataFrame:
    """One row for each code of a document in files of equal bytes."""
    if "archivo_hash" not in scan.columns:
        return scan
    return first_of(scan, ["archivo_hash", "no_doc", "codigo"], "row_seq")


def copy_quality(scan: DataFrame) -> DataFrame:
    """How good each file is as the copy of its document; rows without file
    belong to none."""
    legible = F.col("q") if "q" in scan.columns else to_number(F.col("cant_despachada")) if "cant_despachada" in scan.columns else F.lit(None)
    named = clean_id(F.col("no_doc_archivo")) == clean_id(F.col("no_doc")) if "no_doc_archivo" in scan.columns else F.lit(False)
    return scan.where(F.col("archivo").isNotNull()).groupBy("no_doc", "archivo").agg(F.count_distinct("codigo").alias("codigos"), F.count(legible).alias("legibles"), F.max(named.cast("int")).alias("coincide"))


def best_copy(scan: DataFrame) -> DataFrame:
    """The rows of one file for each document: most codes, then most legible
    quantities, then named as the document, then the first name."""
    if not {"no_doc", "archivo", "codigo"} <= set(scan.columns):
        return scan
    chosen = first_of(copy_quality(scan), ["no_doc"], F.desc("codigos"), F.desc("legibles"), F.desc("coincide"), "archivo").select("no_doc", "archivo")
    return scan.join(chosen, ["no_doc", "archivo"], "left_semi")
