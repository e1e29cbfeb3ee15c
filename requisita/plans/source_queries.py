"""Queries over files and arriving rows, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.report import order_columns
from ..sources import files
from ..sources.adapters import scan, table
from ..sources.scratch import shared_folder
from ..streaming import incremental
from .sql import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


_PATH = "'in/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.Pdf' WHEN 3 THEN '.txt' ELSE '.tiff' END"


def paths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"), "text")


@query("SELECT doc_id, sha256(text) AS archivo_hash FROM documents WHERE text IS NOT NULL")
def file_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("archivo_hash"))


@query(f"SELECT DISTINCT path FROM (SELECT {_PATH} AS path, doc_id FROM documents) WHERE doc_id % 5 IN (0, 1, 4)")
def list_inputs(spark, d):
    return files.list_inputs(paths(spark, d))


@query(f"SELECT path FROM (SELECT {_PATH} AS path, doc_id FROM documents) WHERE doc_id % 3 <> 0")
def skip_done(spark, d):
    every = paths(spark, d).withColumnRenamed("path", "archivo")
    return files.skip_done(every, every.where("doc_id % 3 = 0")).select(F.col("archivo").alias("path"))


@query("""WITH m AS (SELECT 'f' || (event_id % 700) || '.pdf' AS name, event_id AS arrival, event_type AS content, event_id % 4 = 0 AS loose FROM events)
SELECT name, CASE WHEN bool_or(loose) THEN arg_max(content, CASE WHEN loose THEN arrival END) ELSE arg_min(content, arrival) END AS content FROM m GROUP BY name""")
def zip_first_wins(spark, d):
    e = F.col("event_id")
    members = table(spark, d, "events").select(F.concat(F.lit("f"), e % 700, F.lit(".pdf")).alias("name"), e.alias("arrival"), F.col("event_type").alias("content"), (e % 4 == 0).alias("loose"))
    return files.merge_uploads(members.where("not loose"), members.where("loose"))


@query(sql("SELECT archivo, no_doc, codigo, cant_despachada, row_seq FROM scan", "scan"))
def column_order(spark, d):
    return order_columns(scan(spark, d).select("row_seq", "cant_despachada", "codigo", "no_doc", "archivo"))


@query("SELECT user_id, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY user_id")
def stream_rows(spark, d):
    """Events as rows that arrive file by file; the store holds each once."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("user_id").cast("string").alias("archivo"))
    rows.repartitionByRange(4, "user_id").write.parquet(f"{root}/in")
    arriving = incremental.read_rows(spark, f"{root}/in", rows.schema)
    incremental.accumulate(arriving, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return incremental.stored(spark, f"{root}/store").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
