"""Ledger, scan and token tables made from the benchmark tables.

Each table has the same definition as SQL in `requisita.plans.sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import sized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with ``seq``: the line's place in its order under a total
    order of its columns.  Equal rows may trade places."""
    line = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    named = line.withColumn("rn", F.row_number().over(order)).join(sized(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(
        F.col("l_orderkey").alias("o"),
        "rn",
        (F.col("l_orderkey") * 1000 + F.col("rn")).alias("seq"),
        (F.col("l_partkey") + 910000000).alias("code"),
        F.col("l_quantity").alias("qty"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
        F.to_date("l_shipdate").alias("day"),
    )


def _doc(o: Column, shift=0) -> Column:
    return (F.lit(4930000000) + o * 100 + shift).cast("string")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger under the names of the original export."""
    return lines(spark, sf_dir).select(
        F.concat(F.lit(" "), _doc(F.col("o")), F.lit(" ")).alias("Documento material"),
        F.col("code").cast("string").alias("Material"),
        F.col("name").alias("Texto breve de material"),
        F.col("type").alias("Un.medida de entrada"),
        F.col("day").alias("Fe.contabilización"),
        (-F.col("qty")).alias("Ctd.en UM entrada"),
        F.col("seq").alias("row_seq"),
    )


def ledger(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    return (lines(spark, sf_dir) if line is None else line).select(
        _doc(F.col("o")).alias("no_doc"),
        F.col("code").cast("string").alias("codigo"),
        F.col("name").alias("nombre_producto"),
        F.col("type").alias("presentacion"),
        F.col("day").alias("fecha"),
        (-F.col("qty")).cast("string").alias("cant_despachada"),
        F.col("seq").alias("row_seq"),
    )


def scan(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """The same lines as read from paper: documents and lines missing, numbers
    and codes misread, quantities changed, and copies of whole documents."""
    o, seq = F.col("o"), F.col("seq")
    every = lambda n, r=0: F.pmod(seq, F.lit(n)) == r
    docs = lambda n, r=0: F.pmod(o, F.lit(n)) == r
    shift = F.when(docs(17, 3), 1).otherwise(0)
    code = F.col("code") + F.when(every(19), 500000).when(every(23), 10000000).otherwise(0)
    whole = F.col("qty").cast("bigint").cast("string")
    qty = (
        F.when(every(29), F.lit(None).cast("string"))
        .when(every(31), F.lit("0"))
        .when(every(13), (F.col("qty") + 1).cast("bigint").cast("string"))
        .when(every(41), F.concat(F.lit("| "), whole))
        .otherwise(whole)
    )
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamp = F.concat(F.lit("_"), two(1 + F.pmod(o, F.lit(28))), F.lit("."), two(1 + F.pmod(o, F.lit(12))), F.lit(".1996"))
    stamp = F.when(docs(5, 4), F.lit("-2025")).when(docs(50, 7), F.lit("")).otherwise(stamp)
    kept = (lines(spark, sf_dir) if line is None else line).where(~docs(10, 9) & ~every(11))
    copy = F.explode(
        F.filter(
            F.array(F.lit(0), F.when(docs(7) & (F.pmod(F.col("rn"), F.lit(3)) != 0), 1), F.when(docs(37), 2)),
            lambda x: x.isNotNull(),
        )
    )
    return kept.withColumn("copy", copy).select(
        F.concat(F.element_at(F.array(F.lit(""), F.lit("copia_"), F.lit("dup_")), F.col("copy") + 1), _doc(o), stamp, F.lit(".pdf")).alias("archivo"),
        F.concat(F.when(F.col("copy") == 1, "c").otherwise("h"), o.cast("string")).alias("archivo_hash"),
        _doc(o, shift).alias("no_doc"),
        F.when(docs(170, 3), _doc(o)).alias("no_doc_ocr_local"),
        F.when(F.col("copy") == 0, _doc(o)).alias("no_doc_archivo"),
        code.cast("string").alias("codigo"),
        F.when(docs(5), F.upper("name")).otherwise(F.col("name")).alias("nombre_producto"),
        F.lit("UN").alias("presentacion"),
        qty.alias("cant_despachada"),
        (seq * 10 + F.col("copy")).alias("row_seq"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document as tokens on a page: a line is 40 high and a
    character 12 wide; confidence goes by place."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "row"))
    word = line.select("doc_id", "line", F.posexplode(F.split("row", " ")).alias("pos", "text"))
    # a word stands after all words before it and a blank for each
    until = W.partitionBy("doc_id", "line").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(until), F.lit(0))
    placed = word.withColumn("at", before).where(F.length("text") > 0)
    x, y, size = F.col("at") * 12, F.col("line") * 40, F.length("text") * 12
    # long: an int is too small from the 581st line on
    seq = F.col("line").cast("bigint") * 100000 + F.col("pos")
    return placed.select(
        F.col("doc_id").alias("file_id"),
        seq.alias("tok_seq"),
        "text",
        F.pmod(seq * 37, F.lit(101)).cast("int").alias("conf"),
        x.alias("x"),
        y.alias("y"),
        (x + size).alias("x2"),
        (y + 30).alias("y2"),
        (x + size / 2).cast("double").alias("cx"),
        (y + 15).cast("double").alias("cy"),
    )


def _token(text, x, y, size, conf=90) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(text).cast("string").alias("text"), as_column(x).cast("int").alias("x"), as_column(y).cast("int").alias("y"), (as_column(x) + as_column(size)).cast("int").alias("x2"), as_column(conf).cast("int").alias("conf"))


def _placed(df: DataFrame, tokens: list[Column], base: Column) -> DataFrame:
    one = df.select("file_id", base.alias("base"), F.posexplode(F.array(*tokens)).alias("i", "t"))
    return one.select("file_id", (F.col("base") + F.col("i")).alias("tok_seq"), "t.text", "t.conf", "t.x", "t.y", "t.x2", (F.col("t.y") + 20).alias("y2"), ((F.col("t.x") + F.col("t.x2")) / 2).alias("cx"), (F.col("t.y") + 10.0).alias("cy"))


def form_lines(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """Order lines on forms of twenty: file_id and the line's number ``at``."""
    line = lines(spark, sf_dir) if line is None else line
    return line.withColumn("file_id", F.col("o") * 100 + F.floor((F.col("rn") - 1) / 20)).withColumn("at", F.pmod(F.col("rn") - 1, F.lit(20)))


def _form_frame() -> list[tuple]:
    """The words around the lines of a form (o, n): text, x, y, width, confidence."""
    o = F.col("o")
    heads = [("MOV", 50, 40, F.lit("201")), ("ALMACEN", 140, 80, F.concat(F.lit("A"), o % 5)), ("DEPENDENCIA", 250, 100, F.concat(F.lit("D"), o % 7)), ("LOTE", 400, 40, F.concat(F.lit("L"), o % 11)), (F.when(o % 2 == 0, "AÑO").otherwise("ANO"), 520, 40, F.lit("1996")), ("MES", 630, 40, 1 + o % 12), ("Despachada", 730, 80, F.col("n")), ("Despachada", 850, 80, F.lit(0))]
    frame = [t for text, x, size, value in heads for t in ((text, x, 100, size, 90), (value, x, 140, size, 90))]
    frame += [("(1)", 20, 240, 20, 90)] + [(t, x, 300, size, 90) for t, x, size in (("CODIGO", 130, 60), ("NOMBRE", 300, 60), ("PRODUCTO", 400, 100), ("PRESENTACION", 580, 120), ("SOLICITADA", 740, 60), ("DESPACHADA", 860, 60))]
    foot = 360 + 40 * F.col("n")
    frame += [("ULTIMA", 300, foot, 60, 90), ("LINEA", 380, foot, 60, 90), ("910999999", 120, foot + 50, 80, 90), ("DOC.", 100, 1300, 50, 90), (F.lit(4930000000) + o * 100, 200, 1300, 100, 90)]
    return frame + [("SOLICITO", 50, 1350, 80, 90), ("Ana", 50, 1390, 40, 90), ("Paz", 100, 1390, 40, 90), ("ELABORADO", 600, 1350, 100, 90), (":", 705, 1350, 5, 90), ("Luis", 720, 1350, 40, 90), (".", 980, 1480, 20, 90)]


def _form_items(line: Callable[[str], Column], blurred: Column) -> list[tuple]:
    """The words of a line (at, seq, code, qty, name) of a form."""
    at, y = line("at"), 360 + 40 * line("at")
    code = line("code").cast("string")
    read = F.when(line("seq") % 5 == 0, F.overlay(code, F.lit("0"), F.lit(1), F.lit(1))).otherwise(code)
    number = lambda v, x, conf=90: (v.cast("bigint").cast("string"), x, y, 16 * F.length(v.cast("bigint").cast("string")), conf)
    return [(at + 1, 40, y, 20, 90), (read, 120, y, 80, 90), (F.translate(line("name"), " ", "_"), 300, y, 100, 90), ("UN", 600, y, 40, 90), number(line("qty") + 1, 750), number(line("qty"), 870, F.when(blurred, 40).otherwise(90))]


def form_tokens(spark: SparkSession, sf_dir: str, seen: Column | None = None, blurred: Column | None = None) -> DataFrame:
    """Forms 1000 wide and 1500 high as a reader would return them: the lines that
    it has seen, with blurred quantities."""
    line = form_lines(spark, sf_dir)
    page = line.groupBy("file_id", "o").agg(F.count(F.lit(1)).alias("n"))
    items = _form_items(F.col, F.col("seq") % 6 == 5 if blurred is None else blurred)
    placed = lambda df, words, base: _placed(df, [_token(*w) for w in words], base)
    return placed(page, _form_frame(), F.lit(0)).unionByName(placed(line if seen is None else line.where(seen), items, 1000 + F.col("at") * 10))


def _form_name() -> Column:
    kind, page = F.col("o") % 3, F.col("file_id").cast("string")
    name = F.when(kind == 0, _doc(F.col("o"))).when(kind == 1, F.substring(_doc(F.col("o")), 5, 6)).otherwise(F.lit("scan"))
    return F.concat(name, F.lit("_"), page, F.lit(".pdf"))


def form_files(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """file_id, archivo, archivo_hash of the forms: names with the whole number,
    its end, or none."""
    pages = form_lines(spark, sf_dir, line).select("file_id", "o").distinct()
    return pages.select("file_id", _form_name().alias("archivo"), F.sha2(F.col("file_id").cast("string"), 256).alias("archivo_hash"))


def form_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the forms at two resolutions, each of which misses lines (but
    never the first)."""
    seq, first = F.col("seq"), F.col("at") == 0
    low = form_tokens(spark, sf_dir, first | (seq % 11 != 0)).withColumn("dpi", F.lit(300))
    high = form_tokens(spark, sf_dir, first | (seq % 13 != 0), F.lit(False)).withColumn("dpi", F.lit(400))
    return low.unionByName(high).join(form_files(spark, sf_dir).select("file_id", "archivo"), "file_id").drop("file_id")


def form_pages(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """``form_readings`` with a row for each page, whose ``words`` are an array."""

    def word(seq, token):
        text, x, y, size, conf = token
        c = {"tok_seq": seq, "text": text, "conf": conf, "x": x, "y": y, "x2": x + size, "y2": y + 20, "cx": (x + x + size) / 2, "cy": y + 10.0}
        kinds = dict.fromkeys(c, "int") | {"text": "string", "cx": "double", "cy": "double"}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds[k]).alias(k) for k, v in c.items()])

    def items(s):
        at = s["at"]
        seq, tokens = 1000 + at * 10, _form_items(lambda c: s[c], s["seq"] % 6 == 5)
        words = [word(seq + i, t) for i, t in enumerate(tokens)]
        clear = word(seq + len(tokens) - 1, (*tokens[-1][:4], 90))
        seen = lambda n: (at == 0) | (s["seq"] % n != 0)
        return F.struct(seen(11).alias("in_low"), seen(13).alias("in_high"), F.array(*words[:-1]).alias("words"), words[-1].alias("low"), clear.alias("high"))

    row = F.struct("at", "seq", "code", "qty", "name")
    page = form_lines(spark, sf_dir, line).groupBy("file_id", "o").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(row)).alias("lines"))
    page = page.select(_form_name().alias("archivo"), F.array(*[word(i, t) for i, t in enumerate(_form_frame())]).alias("frame"), F.transform("lines", items).alias("items"))
    seen = lambda name: F.flatten(F.transform(F.filter("items", lambda s: s[f"in_{name}"]), lambda s: F.concat(s["words"], F.array(s[name]))))
    both = [F.struct(F.lit(dpi).alias("dpi"), F.concat("frame", seen(name)).alias("words")) for dpi, name in ((300, "low"), (400, "high"))]
    return page.select("archivo", F.inline(F.array(*both)))


def receipt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods receipts, one for each part."""
    part = table(spark, sf_dir, "part").withColumn("file_id", F.col("p_partkey"))
    k = F.col("p_partkey")
    amount = F.when(k % 3 == 0, F.concat((k % 900 + 1).cast("string"), F.lit(",500"))).when(k % 3 == 1, F.concat((k % 50 + 1).cast("string"), F.lit(".0"))).otherwise((k % 70 + 1).cast("string"))
    code = (k + 910000000).cast("string")
    tokens = [_token("ACTA", 100, 50, 60), _token("RECIBIDO", 700, 300, 80), _token(amount, 710, 340, 60), _token("77", 100, 340, 20), _token(code, 100, 500, 90), _token("Papel", 250, 500, 60), _token("|", 320, 500, 5), _token("bond", 340, 505, 50), _token(F.lit("910999999"), 100, 560, 90), _token(code, 100, 900, 90), _token(".", 980, 1480, 20)]
    return _placed(part, tokens, F.lit(0))
