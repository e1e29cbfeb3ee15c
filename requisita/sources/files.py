"""Files in: listing, ZIP archives, skip lists, the ledger; datasets out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_of
from ..operators.reconcile import normalize_ledger

#: Endings of files that are read, all small or all capital.
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
MEMBER = "name string, content binary, arrival long"


def supported(path: Column) -> Column:
    """Mixed case such as ``.Pdf`` is not an ending that is looked for."""
    ends = F.lit(False)
    for s in SUFFIXES:
        ends = ends | F.endswith(path, F.lit(s)) | F.endswith(path, F.lit(s.upper()))
    return ends


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_inputs(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct supported paths in order; with a limit, the first of them."""
    found = paths.select("path").where(supported(F.col("path"))).distinct().orderBy("path")
    return found.limit(limit) if limit else found


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, archivo, archivo_hash, content of each supported file of a folder."""
    raw = spark.read.format("binaryFile").load(folder).where(supported(F.col("path")))
    return raw.select("path", base_name(F.col("path")).alias("archivo"), F.sha2("content", 256).alias("archivo_hash"), "content")


def skip_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose name was not processed yet."""
    return files.join(done.select("archivo").distinct(), "archivo", "left_anti")


def unzip(archives: DataFrame) -> DataFrame:
    """name, content, arrival of the supported members of archives (content,
    arrival); folders and hidden files are left out.  Bad archives give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, arrival in zip(pdf["content"], pdf["arrival"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i, m in enumerate(z.infolist()):
                            name = m.filename.replace("\\", "/").rsplit("/", 1)[-1]
                            if not m.is_dir() and name and not name.startswith(".") and name.lower().endswith(SUFFIXES):
                                rows.append((name, z.read(m), int(arrival) * 1_000_000 + i))
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame(rows, columns=["name", "content", "arrival"])

    return archives.select("content", "arrival").mapInPandas(run, MEMBER)


def merge_uploads(members: DataFrame, loose: DataFrame) -> DataFrame:
    """One file for each name: the first of the archives, but the last loose one
    before any of them."""
    first = first_of(members, ["name"], "arrival").select("name", "content")
    last = first_of(loose, ["name"], F.desc("arrival")).select("name", "content")
    return first.join(last.select("name"), "name", "left_anti").unionByName(last)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger from CSV or Parquet, under our names, with the row's place.  All
    CSV columns are text.  Workbooks are read by pandas on the driver, where a
    reader for them is installed."""
    lower = path.lower()
    if lower.endswith((".xls", ".xlsx")):
        raw = spark.createDataFrame(pd.read_excel(path, dtype=str))
    elif lower.endswith(".csv"):
        raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
        from ..operators.reconcile import EXPORT_QUANTITY

        if EXPORT_QUANTITY in raw.columns:
            raw = raw.withColumn(EXPORT_QUANTITY, F.col(f"`{EXPORT_QUANTITY}`").try_cast("double"))
    else:
        raw = spark.read.parquet(path)
    ledger = normalize_ledger(raw)
    if "fecha" in ledger.columns:
        ledger = ledger.withColumn("fecha", F.col("fecha").try_cast("date"))
    return ledger.withColumn("row_seq", F.monotonically_increasing_id())


def write_dataset(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One dataset; CSV gets a heading and one file."""
    if kind == "csv":
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def write_report(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Named datasets side by side; a name has 31 characters at most."""
    for name, df in tables.items():
        write_dataset(df, f"{folder}/{name[:31]}", kind)
