"""Written intermediate tables, in the folder that a cluster's nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, a temporary folder on a
    single machine; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = getattr(spark, "_requisita_scratch", None) or tempfile.mkdtemp(prefix="requisita-")
        spark._requisita_scratch = found
    return found.rstrip("/")


#: Shuffle files go as soon as the table that they were made for is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How many bytes of rows a byte of a file stands for when joins are planned.
FACTOR = "spark.sql.sources.fileCompressionFactor"


def is_kept(df: DataFrame) -> bool:
    return "_requisita_path" in vars(df)


def sized(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table, planned with the size of its rows instead of that of its
    compressed files, by which large tables would be broadcast.

    Rows are counted from the files' footers.  The factor is set in a copy of the
    session that only this table's files refer to; the caller's stays as it is."""
    plain = spark.read.schema(schema) if schema else spark.read
    rows = plain.parquet(path).count()
    own = spark._jsparkSession.cloneSession()
    own.conf().set(FACTOR, "1.0")
    read = (own.read().schema(spark._jsparkSession.parseDataType(schema.json())) if schema else own.read()).parquet(path)
    files = int(read.queryExecution().optimizedPlan().stats().sizeInBytes())
    own.conf().set(FACTOR, str(max(1.0, rows * (8 + read.schema().defaultSize()) / max(1, files))))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, read.queryExecution().analyzed()), spark)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back: what follows never recomputes it.  A
    table that was just read back is not written again."""
    if is_kept(df):
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    kept = sized(spark, path, df.schema)
    kept._requisita_path = path
    return kept


def drop(*kept: DataFrame) -> None:
    """Deletes tables that ``keep`` returned and no pending plan reads any more."""
    for df in kept:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._requisita_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
