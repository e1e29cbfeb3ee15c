"""Files that arrive one after another: each micro-batch is appended, and the
comparison is made anew from all rows (it is not monotone: a later copy may
replace an earlier one).  Batches are written by number, so a batch that runs
again after a crash replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reconcile import compare
from ..operators.report import document_summary

#: Files a micro-batch: each file alone while there are few, else five.
FEW_FILES, MANY_AT_A_TIME = 20, 5


def cadence(files: int) -> int:
    return 1 if files <= FEW_FILES else MANY_AT_A_TIME


def read_rows(spark, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def accumulate(rows: DataFrame, store: str, checkpoint: str, refresh: Callable[[DataFrame, int], None] | None = None):
    """Starts the query that appends rows (archivo, ...) under ``store``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        if refresh:
            refresh(stored(batch.sparkSession, store), number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark, store: str) -> DataFrame:
    """All rows so far; a file that came again counts as it came last."""
    every = spark.read.parquet(store)
    last = every.groupBy("archivo").agg(F.max("batch").alias("batch"))
    return every.join(last, ["archivo", "batch"], "left_semi").drop("batch")


def live_summary(ledger: DataFrame, scan: DataFrame) -> DataFrame:
    return document_summary(compare(ledger, scan))
