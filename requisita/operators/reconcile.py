"""Comparison of the ledger with what was scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TOLERANCE, clean_id, to_number
from ..sources.scratch import drop, keep
from .dedup import best_copy, physical_dedup
from .repair import renumber, repair_codes

KEYS = ["no_doc", "codigo"]
#: Columns of the original export and the names they get here.
EXPORT_NAMES = {
    "Documento material": "no_doc",
    "Material": "codigo",
    "Texto breve de material": "nombre_producto",
    "Almacén": "almacen",
    "Clase de movimiento": "mov",
    "Un.medida de entrada": "presentacion",
    "Centro de coste": "depend_destinataria",
    "Fe.contabilización": "fecha",
    "Nombre 1": "centro_receptor",
    "Nombre del usuario": "usuario_safiss",
}
EXPORT_QUANTITY = "Ctd.en UM entrada"
STATES = ("ok", "solo_externa", "solo_escaneada", "fuera_rango", "cant_despachada_difiere")


def is_export(df: DataFrame) -> bool:
    return {"Material", "Documento material", EXPORT_QUANTITY} <= set(df.columns)


def normalize_ledger(df: DataFrame) -> DataFrame:
    """The ledger under our names; a ledger that has them is returned as it is."""
    if not is_export(df):
        return df
    kinds = dict(df.dtypes)
    named = df.withColumnsRenamed(EXPORT_NAMES)
    for old, new in EXPORT_NAMES.items():
        if old in kinds and new in ("no_doc", "codigo", "almacen", "mov"):
            named = named.withColumn(new, clean_id(F.col(new), kinds[old]))
    return named.withColumn("cant_despachada", F.abs(F.col(f"`{EXPORT_QUANTITY}`")))


def require_keys(df: DataFrame) -> None:
    for key in KEYS:
        if key not in df.columns:
            raise ValueError(f"column '{key}' is missing")


def with_keys(df: DataFrame) -> DataFrame:
    """Clean keys, rows without one dropped, and the quantity as number ``q``."""
    require_keys(df)
    kinds = dict(df.dtypes)
    clean = df.withColumns({k: clean_id(F.col(k), kinds[k]) for k in KEYS}).where("no_doc <> '' and codigo <> ''")
    quantity = to_number(F.col("cant_despachada")) if "cant_despachada" in df.columns else F.lit(None).cast("double")
    return clean.withColumn("q", quantity)


def prepare_ledger(df: DataFrame) -> DataFrame:
    return with_keys(df).withColumn("q", F.abs("q"))


def of_scanned_documents(ledger: DataFrame, scan: DataFrame) -> DataFrame:
    """Ledger rows of scanned documents; all rows if nothing was scanned."""
    docs = scan.select("no_doc").distinct().withColumn("scanned", F.lit(True))
    any_scanned = scan.agg((F.count(F.lit(1)) > 0).alias("any_scanned"))  # one row
    return ledger.join(docs, "no_doc", "left").crossJoin(F.broadcast(any_scanned)).where("scanned or not any_scanned").drop("scanned", "any_scanned")


def dispatched(ledger: DataFrame) -> DataFrame:
    return ledger.where("q > 0")


def not_zero(scan: DataFrame) -> DataFrame:
    """Lines that were dispatched, or whose quantity can't be read."""
    return scan.where("q is null or q <> 0")


def aggregate_by_key(df: DataFrame) -> DataFrame:
    """Partial dispatches of a code in a document, summed; of other columns the
    first value that is not null.  A sum of nothing is 0."""
    rest = [c for c in df.columns if c not in (*KEYS, "q", "cant_despachada", "row_seq")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_seq"))).alias(c) for c in rest]
    return df.groupBy(*KEYS).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("cant_despachada"), *first)


def full_outer_diff(ledger: DataFrame, scan: DataFrame) -> DataFrame:
    """Outer join of two aggregated sides; only columns of both get a suffix."""
    both = [c for c in ledger.columns if c in scan.columns and c not in KEYS]
    left = ledger.withColumnsRenamed({c: f"{c}_ext" for c in both}).withColumn("_ext", F.lit(True))
    right = scan.withColumnsRenamed({c: f"{c}_esc" for c in both}).withColumn("_esc", F.lit(True))
    joined = left.join(right, KEYS, "full_outer")
    differs = F.abs(F.col("cant_despachada_ext") - F.col("cant_despachada_esc")) > TOLERANCE
    state = F.when(F.col("_esc").isNull(), "solo_externa").when(F.col("_ext").isNull(), "solo_escaneada").when(differs, "cant_despachada_difiere").otherwise("ok")
    lead = ["estado", *KEYS]
    pairs = [f + s for f in ("cant_despachada", "nombre_producto", "presentacion") for s in ("_ext", "_esc") if f + s in joined.columns]
    rest = [c for c in joined.columns if c not in (*lead, *pairs, "_ext", "_esc")]
    return joined.withColumn("estado", state).select(*lead, *pairs, *rest)


def cleaned(ledger: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides clean, the scan without copies; written, as several steps read
    them."""
    listed = keep(prepare_ledger(ledger), "ledger")
    physical = keep(physical_dedup(with_keys(scan)), "physical")
    copies = keep(best_copy(physical), "copies")
    drop(physical)
    return listed, copies


def sides(ledger: DataFrame, scan: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides ready for aggregation: copies gone, numbers and codes corrected.

    What several later steps read is written once: both sides clean, and the
    scan under its corrected numbers.  Without ``fuzzy``, codes are corrected by
    one edit only, not by similar codes or descriptions."""
    listed, copies = cleaned(ledger, scan)
    numbered = keep(renumber(listed, copies)[0], "numbered")
    drop(copies)
    listed = dispatched(of_scanned_documents(listed, numbered))
    return listed, repair_codes(listed, not_zero(numbered), fuzzy)


def compare(ledger: DataFrame, scan: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Each (document, code) of either side with its state."""
    listed, seen = sides(ledger, scan, fuzzy)
    return full_outer_diff(aggregate_by_key(listed), aggregate_by_key(seen))
