"""From the words of scanned files, at one or two resolutions, to scan rows.

Readings that something else makes (a strip of the page, a cell, an outside
model) come as tables; where one is not given, its step is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import accept_local_cell, agreement, filename_doc, needs_refinement, pick_best_quantity, resolve_doc_number
from ..sources.scratch import keep
from .dedup import first_of
from .extraction import clean_cell, consensus, exact_digits, header_fallback, parse_replies, upsert
from .forms import HEADER_FIELDS, ROWS, SIGNATURE_FIELDS, found_items, header, may_be_receipt, number, read_items, schema_of, signatures
from .pages import Pages, on_pages
from .report import order_columns

LOW, HIGH = 300, 400
PAGE = ["archivo", "dpi"]
NUMBER = ["no_doc", "no_doc_ocr_local", "no_doc_archivo", "no_doc_fuente", "no_doc_coincide_archivo"]
TEXTS = ["idem", "nombre_producto", "presentacion"]
QUANTITIES = ["cant_solicitada", "cant_despachada"]
BOX = ["box_y1", "box_y2"]
#: Fixed value: what a file without any word gets as its error.
NOTHING_READ = "OCR sin resultados"


def commonest_number(strips: DataFrame) -> DataFrame:
    """archivo, dpi, no_doc: the ten digits that the readings of a strip (archivo,
    dpi, text) hold most often; of equals the smallest."""
    each = strips.select(*PAGE, F.explode(F.regexp_extract_all("text", F.lit("(?<![0-9])([0-9]{10})(?![0-9])"), 1)).alias("no_doc"))
    counted = each.groupBy(*PAGE, "no_doc").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*PAGE).agg(F.min_by("no_doc", F.struct(-F.col("n"), F.col("no_doc"))).alias("no_doc"))


def read_page(p: Pages) -> dict[str, list]:
    return header(p) | signatures(p) | {"printed": number(p), "rows": read_items(p)}


def read_pages(tokens: DataFrame, master: DataFrame, strips: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Headers and items of each page (archivo, dpi).  tokens: archivo, dpi and
    the columns of a word, or ``words``, the array of a page's."""
    pages = tokens.withColumn("file_id", F.struct(*PAGE)).drop(*PAGE)
    if "words" in pages.columns:
        pages = pages.withColumn("words", F.filter("words", lambda w: w["text"].isNotNull()))
    else:
        pages = pages.where("text is not null")
    # each page is read once; what follows needs its words no more
    read = keep(on_pages(pages, read_page, f"{schema_of([*HEADER_FIELDS, *SIGNATURE_FIELDS, 'printed'])}, {ROWS}", may_be_receipt), "pages")
    base = read.drop("rows", "receipt").select("file_id.*", "*").drop("file_id")
    if strips is None:
        base = base.withColumn("no_doc_ocr_local", F.col("printed"))
    else:
        base = base.join(commonest_number(strips), PAGE, "left").withColumn("no_doc_ocr_local", F.coalesce("no_doc", "printed")).drop("no_doc")
    named = base.withColumn("no_doc_archivo", filename_doc(F.col("archivo")))
    solved = named.withColumn("_r", resolve_doc_number(F.col("no_doc_archivo"), F.col("no_doc_ocr_local"), F.lit(None).cast("string")))
    done = solved.withColumns({"no_doc": F.col("_r.no_doc"), "no_doc_fuente": F.col("_r.source")}).withColumn("no_doc_coincide_archivo", agreement(F.col("no_doc"), F.col("no_doc_archivo")))
    return keep(done.drop("printed", "_r"), "headers"), keep(found_items(read, master).select("file_id.*", "*").drop("file_id"), "items")


def one_header(headers: DataFrame) -> DataFrame:
    """A header for each file: of the lower resolution, with the other's number
    where only that one read one."""
    of = lambda dpi: headers.where(F.col("dpi") == dpi).drop("dpi").withColumnRenamed("archivo", "file_id")
    return header_fallback(of(LOW), of(HIGH), NUMBER, "no_doc_ocr_local").withColumnRenamed("file_id", "archivo")


def with_model_number(headers: DataFrame, replies: DataFrame) -> DataFrame:
    """The number decided anew where a model's reply (archivo, text) has ten
    digits.  It agrees with the file's name wherever the name has a number."""
    read = replies.groupBy("archivo").agg(F.max(exact_digits(F.col("text"), 10)).alias("no_doc_gemini"))
    met = headers.join(read, "archivo", "left").withColumn("no_doc_coincide_ocr", agreement(F.col("no_doc_gemini"), F.col("no_doc_ocr_local")))
    met = met.withColumn("_r", resolve_doc_number(F.col("no_doc_archivo"), F.col("no_doc_ocr_local"), F.col("no_doc_gemini")))
    new = F.col("no_doc_gemini").isNotNull()
    same = F.when(F.col("no_doc_archivo").isNotNull(), F.col("_r.no_doc").eqNullSafe(F.col("no_doc_archivo")))
    decided = {"no_doc_coincide_archivo": same, "no_doc": F.col("_r.no_doc"), "no_doc_fuente": F.col("_r.source")}
    return met.withColumns({c: F.when(new, v).otherwise(F.col(c)) for c, v in decided.items()}).drop("_r")


def rekey_items(items: DataFrame, replies: DataFrame, master: DataFrame) -> DataFrame:
    """Items whose code is not in the master, under the code that a model reads
    (archivo, dpi, codigo, text), unless a row above has it.  With an empty master
    any nine digits count.  A page has few rows, so it is decided in one fold."""
    read = replies.select(*PAGE, "codigo", exact_digits(F.col("text"), 9).alias("new")).where("new is not null")
    known = master.select(F.col("codigo").alias("new")).distinct()
    if not master.isEmpty():
        read = read.join(known, "new", "left_semi")
    read = read.groupBy(*PAGE, "codigo").agg(F.min("new").alias("new"))
    met = items.join(read, [*PAGE, "codigo"], "left").withColumn("new", F.when(~F.col("verified") & F.col("box_y1").isNotNull() & (F.col("new") != F.col("codigo")), F.col("new")))
    row = F.struct("box_y1", "codigo", "new")
    empty = F.array().cast("array<struct<codigo:string,key:string>>")

    def place(done, r):
        taken = F.exists(done, lambda p: p["key"] == r["new"])
        key = F.when(r["new"].isNotNull() & ~taken, r["new"]).otherwise(r["codigo"])
        return F.concat(done, F.array(F.struct(r["codigo"].alias("codigo"), key.alias("key"))))

    keys = met.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(row)), empty, place).alias("keys")).select(*PAGE, F.posexplode("keys").alias("turn", "k")).select(*PAGE, "turn", "k.*")
    moved = met.drop("new").join(keys, [*PAGE, "codigo"]).withColumn("verified", F.col("verified") | (F.col("key") != F.col("codigo"))).withColumn("codigo", F.col("key"))
    return first_of(moved, [*PAGE, "codigo"], F.desc("turn")).drop("turn", "key")


def merge_pages(items: DataFrame) -> DataFrame:
    """One row for each code of a file: texts, and the box with its resolution,
    of the lower resolution if that has the code, and the better of both
    quantities."""
    of = lambda dpi, name: items.where(F.col("dpi") == dpi).select("archivo", "codigo", F.struct(*TEXTS, *QUANTITIES, "dpi", *BOX).alias(name))
    both = of(LOW, "l").join(of(HIGH, "h"), ["archivo", "codigo"], "full_outer").withColumn("v", F.coalesce("l", "h"))
    best = lambda c: pick_best_quantity(F.trim(F.coalesce(f"l.{c}", F.lit(""))), F.trim(F.coalesce(f"h.{c}", F.lit(""))))
    return both.select("archivo", "codigo", *[F.col(f"v.{c}").alias(c) for c in (*TEXTS, "dpi", *BOX)], *[best(c).alias(c) for c in QUANTITIES])


def cells_to_read(rows: DataFrame) -> DataFrame:
    """archivo, codigo, dpi and box of the dispatched quantities to read again."""
    again = needs_refinement(F.coalesce("cant_despachada", F.lit("")), F.coalesce("cant_solicitada", F.lit("")))
    return rows.where(again & F.col("box_y1").isNotNull()).select("archivo", "codigo", "dpi", *BOX)


def with_local_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with second readings of cells (archivo, codigo, text) where they count."""
    read = cells.groupBy("archivo", "codigo").agg(F.max("text").alias("_cell"))
    current, asked = F.coalesce("cant_despachada", F.lit("")), F.coalesce("cant_solicitada", F.lit(""))
    taken = accept_local_cell(current, F.coalesce("_cell", F.lit("")), asked)
    return rows.join(read, ["archivo", "codigo"], "left").withColumn("cant_despachada", taken).drop("_cell")


def with_table_replies(rows: DataFrame, items: DataFrame, replies: DataFrame, master: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Rows with what a model's readings of the whole table (archivo, reply, text)
    agree on; of the others, the model's reading of the cell (archivo, codigo,
    text), if it gave one."""
    counts = items.groupBy("archivo", "dpi").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("archivo").alias("file_id")).agg(F.max("n").alias("n"))
    named = replies.withColumnRenamed("archivo", "file_id")
    files = named.select("file_id").distinct().join(counts, "file_id", "left").na.fill(1, ["n"])
    claims = parse_replies(named, None if master.isEmpty() else master)
    confirmed = keep(consensus(claims, files), "confirmed")
    done = upsert(rows.withColumnRenamed("archivo", "file_id"), confirmed).withColumnRenamed("file_id", "archivo")
    if cells is None:
        return done
    agreed = confirmed.select(F.col("file_id").alias("archivo"), "codigo", F.lit(True).alias("_agreed"))
    read = cells.groupBy("archivo", "codigo").agg(F.max(F.nullif(clean_cell(F.col("text")), F.lit(""))).alias("_cell"))
    met = done.join(agreed, ["archivo", "codigo"], "left").join(read, ["archivo", "codigo"], "left")
    use = F.col("_agreed").isNull() & F.col("_cell").isNotNull() & F.col("box_y1").isNotNull()
    return met.withColumn("cant_despachada", F.when(use, F.col("_cell")).otherwise(F.col("cant_despachada"))).drop("_agreed", "_cell")


def process_documents(
    files: DataFrame, tokens: DataFrame, master: DataFrame, strips: DataFrame | None = None, cells: DataFrame | None = None,
    numbers: DataFrame | None = None, codes: DataFrame | None = None, tables: DataFrame | None = None, model_cells: DataFrame | None = None,
) -> DataFrame:
    """Scan rows of files (archivo, archivo_hash): the header of each file with
    each of its items, the header alone if it has none, and an error where no
    word was read.  tokens: a row for each word or, with ``words``, each page."""
    headers, items = read_pages(tokens, master, strips)
    top = one_header(headers)
    if numbers is not None:
        top = with_model_number(top, numbers)
    if codes is not None:
        items = keep(rekey_items(items, codes, master), "rekeyed")
    rows = merge_pages(items)
    if cells is not None:
        rows = with_local_cells(rows, cells)
    if tables is not None:
        rows = with_table_replies(rows, items, tables, master, model_cells)
    rows = rows.select("archivo", "codigo", *TEXTS, *QUANTITIES)
    error = F.when(F.col("_read").isNull(), F.lit(NOTHING_READ)).alias("error")
    whole = files.select("archivo", "archivo_hash").join(top.withColumn("_read", F.lit(True)), "archivo", "left").join(rows, "archivo", "left")
    return order_columns(whole.select(*(c for c in whole.columns if c != "_read"), error))


def extract_folder(spark: SparkSession, folder: str, recognise: Callable, master: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Scan rows of the files of a folder, without those whose names (archivo)
    are done.  PDF files are read at two resolutions, images at one; files without
    a byte are not seen."""
    from ..sources.files import read_files, skip_done
    from ..sources.providers import recognise_files

    files = read_files(spark, folder)
    files = skip_done(files, done) if done is not None else files
    is_pdf = F.endswith(F.lower("archivo"), F.lit(".pdf"))
    tokens = recognise_files(files.where(is_pdf), recognise, (LOW, HIGH)).unionByName(recognise_files(files.where(~is_pdf), recognise, (LOW,)))
    return process_documents(files, keep(tokens, "tokens"), master)
