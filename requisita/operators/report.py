"""Roll-ups of the comparison: documents, periods, key figures, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_id, date_range_from_filename
from .dedup import first_of

OUT_OF_RANGE = "fuera de rango SAFISS"
MISMATCH = "; número de archivo ≠ escaneo"
#: Preferred order of the columns of an extraction.
COLUMN_ORDER = (
    "archivo", "no_doc", "mov", "almacen", "depend_destinataria", "lote", "año", "mes", "total_despachada", "total_no_despachada",
    "solicito", "autorizo", "recibio", "preparado_por", "comprobado_por", "elaborado",
    "idem", "codigo", "nombre_producto", "presentacion", "cant_solicitada", "cant_despachada",
)


def document_summary(merged: DataFrame) -> DataFrame:
    ok = F.col("estado") == "ok"
    issues = F.concat_ws(
        ", ",
        F.when(F.bool_or(F.contains("estado", F.lit("difiere"))), F.lit("cantidad ≠")),
        F.when(F.bool_or(F.col("estado") == "solo_externa"), F.lit("faltan escaneadas")),
        F.when(F.bool_or(F.col("estado") == "solo_escaneada"), F.lit("faltan en SAFISS")),
    )
    diagnosis = F.when(F.bool_and(ok), F.lit("OK")).otherwise(F.coalesce(F.nullif(issues, F.lit("")), F.lit("revisar")))
    return merged.groupBy("no_doc").agg(F.count(F.lit(1)).alias("items"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("con_problemas"), diagnosis.alias("diagnóstico"))


def summary_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("con_problemas"), "no_doc")


def document_dates(scan: DataFrame) -> DataFrame:
    """no_doc, start, end, label: from the last file, in scan order, whose name
    has a date; a file counts where its name first appears."""
    files = scan.groupBy(clean_id(F.col("no_doc")).alias("no_doc"), "archivo").agg(F.min("row_seq").alias("seq"))
    dated = files.withColumn("range", date_range_from_filename(F.col("archivo"))).where("range is not null")
    return dated.groupBy("no_doc").agg(F.max_by("range", "seq").alias("range")).select("no_doc", "range.*")


def coverage(ledger: DataFrame) -> DataFrame:
    """One row: first and last day of the months that the ledger covers."""
    return ledger.agg(F.trunc(F.min("fecha"), "MM").alias("lo"), F.last_day(F.max("fecha")).alias("hi"))


def out_of_range(summary: DataFrame, merged: DataFrame, scan: DataFrame, ledger: DataFrame) -> DataFrame:
    """no_doc, label: documents without a ledger row, dated outside its months."""
    listed = merged.where("cant_despachada_ext is not null").select("no_doc").distinct()
    alone = summary.join(listed, "no_doc", "left_anti").join(document_dates(scan), "no_doc")
    return alone.crossJoin(F.broadcast(coverage(ledger))).where("lo is not null and (end < lo or start > hi)").select("no_doc", "label")


def mismatched_documents(scan: DataFrame, column: str = "no_doc_coincide_archivo") -> DataFrame:
    """Documents with a reading known to differ."""
    return scan.where(F.col(column) == F.lit(False)).select("no_doc").distinct()


def tag_summary(summary: DataFrame, outside: DataFrame, mismatched: DataFrame) -> DataFrame:
    tagged = summary.join(outside.select("no_doc", F.lit(True).alias("out")), "no_doc", "left").join(mismatched.withColumn("differs", F.lit(True)), "no_doc", "left")
    text = F.when(F.col("out"), F.lit(OUT_OF_RANGE)).otherwise(F.col("diagnóstico"))
    return tagged.withColumn("diagnóstico", F.when(F.col("differs"), F.concat(text, F.lit(MISMATCH))).otherwise(text)).drop("out", "differs")


def tag_detail(merged: DataFrame, outside: DataFrame) -> DataFrame:
    flagged = merged.join(outside.select("no_doc", F.lit(True).alias("out")), "no_doc", "left")
    return flagged.withColumn("estado", F.when(F.col("out"), F.lit("fuera_rango")).otherwise(F.col("estado"))).drop("out").select(*merged.columns)


def one_per_file(scan: DataFrame) -> DataFrame:
    files = first_of(scan, ["archivo"], "row_seq")
    return files.select(*[c for c in ("archivo", "archivo_hash", "no_doc", "no_doc_archivo", "no_doc_fuente") if c in files.columns])


def duplicate_copies(scan: DataFrame) -> DataFrame:
    """Files of documents that several files hold, with their number."""
    files = one_per_file(scan)
    counts = files.groupBy("no_doc").agg(F.count("archivo").alias("copias")).where("copias > 1")
    return files.join(counts, "no_doc")


def contains(column: str, text: str):
    return F.coalesce(F.contains(column, F.lit(text)), F.lit(False))


def key_figures(summary: DataFrame, mismatched: DataFrame, scan: DataFrame) -> DataFrame:
    """One row of totals; ``summary`` is tagged."""
    d = "diagnóstico"
    totals = summary.agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("ok") == F.col("items")).alias("docs_ok"), F.count_if(contains(d, OUT_OF_RANGE)).alias("docs_out"),
        F.count_if(contains(d, "cantidad")).alias("docs_diff"), F.count_if(contains(d, "faltan en SAFISS")).alias("docs_faltan_safiss"), F.count_if(contains(d, "faltan escaneadas")).alias("docs_faltan_esc"),
    )
    files = one_per_file(scan)
    per_doc = files.where("no_doc is not null").groupBy("no_doc").agg((F.count(F.lit(1)) - 1).alias("extra"))
    one = (files.agg(F.count(F.lit(1)).alias("files")), per_doc.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra_copies")), mismatched.agg(F.count(F.lit(1)).alias("docs_mismatch")))
    for row in one:  # each side is one row
        totals = totals.crossJoin(F.broadcast(row))
    return totals.withColumn("docs_bad", F.col("docs") - F.col("docs_ok") - F.col("docs_out")).withColumn("pct_ok", F.round(100 * F.col("docs_ok") / F.greatest(F.col("docs"), F.lit(1)), 6))


def status_filter(merged: DataFrame, state: str | None = None, only_bad: bool = False) -> DataFrame:
    """A chosen state; or, if none is, all that is not ok."""
    if state:
        return merged.where(F.col("estado") == state)
    return merged.where("estado <> 'ok'") if only_bad else merged


def search_filter(merged: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return merged.where(F.lower("no_doc").rlike(q) | F.lower("codigo").rlike(q))


def reprocessable(summary: DataFrame) -> DataFrame:
    return summary.where((F.col("con_problemas") > 0) & ~contains("diagnóstico", OUT_OF_RANGE))


def page_slice(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def state_label(merged: DataFrame) -> DataFrame:
    """The sign and words of each state."""
    label = (
        F.when(F.col("estado") == "ok", "✅ OK").when(F.col("estado") == "solo_externa", "⚠️ Solo en SAFISS").when(F.col("estado") == "solo_escaneada", "📄 Solo escaneada")
        .when(F.col("estado") == "fuera_rango", "📅 Fuera de rango SAFISS").otherwise(F.concat(F.lit("❌ "), F.col("estado")))
    )
    return merged.withColumn("etiqueta", label)


def order_columns(df: DataFrame) -> DataFrame:
    lead = [c for c in COLUMN_ORDER if c in df.columns]
    return df.select(*lead, *(c for c in df.columns if c not in lead))


def failing_files(scan: DataFrame, summary: DataFrame) -> DataFrame:
    """Files of documents with problems."""
    return scan.join(summary.where("con_problemas > 0").select("no_doc"), "no_doc", "left_semi").where("archivo is not null").select("archivo").distinct()


def replace_rows(scan: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of files that were read again give way to the new rows."""
    rest = scan.join(new.select("archivo").distinct(), "archivo", "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)
