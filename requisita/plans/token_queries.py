"""Queries over tokens, forms, codes and readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import accept_local_cell, needs_refinement, pick_best_quantity, receipt_quantity, resolve_doc_number, agreement
from ..operators import codes, documents, extraction, forms, tokens
from ..sources import adapters
from ..sources.adapters import table
from ..sources.scratch import keep
from .sql import block, sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


block("rows_of", "SELECT doc_id, i - 1 AS line, string_split(t[i], ' ') AS parts FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE length(text) > 0)")
block("parts_of", """SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs
FROM (SELECT doc_id, line, p - 1 AS pos, parts[p] AS text FROM (SELECT doc_id, line, parts, unnest(range(1, len(parts) + 1)) AS p FROM rows_of))""", "rows_of")
block("tokens", """SELECT doc_id AS file_id, line * 100000 + pos AS tok_seq, text, CAST(((line * 100000 + pos) * 37) % 101 AS INTEGER) AS conf, CAST(ofs * 12 AS BIGINT) AS x, line * 40 AS y, CAST(ofs * 12 + length(text) * 12 AS BIGINT) AS x2, line * 40 + 30 AS y2,
CAST(ofs * 12 + length(text) * 12 / 2 AS DOUBLE) AS cx, CAST(line * 40 + 15 AS DOUBLE) AS cy FROM parts_of WHERE length(text) > 0""", "parts_of")
FIELDS = {"the": ["THE"], "ing": ["IN", "G"], "der": ["DER"]}
block("marked", """SELECT t.*, f.field FROM tokens t JOIN (VALUES ('the', 'THE', ''), ('ing', 'IN', 'G'), ('der', 'DER', '')) f(field, u, v) ON contains(upper(text), u) AND contains(upper(text), v)""", "tokens")
block("anchor", "SELECT file_id, field, arg_min(tok_seq, tok_seq) AS a_tok_seq, arg_min(x, tok_seq) AS a_x, arg_min(y, tok_seq) AS a_y, arg_min(x2, tok_seq) AS a_x2, arg_min(y2, tok_seq) AS a_y2, arg_min(cx, tok_seq) AS a_cx, arg_min(cy, tok_seq) AS a_cy FROM marked GROUP BY ALL", "marked")
block("met", "SELECT * FROM tokens JOIN anchor USING (file_id) WHERE tok_seq <> a_tok_seq", "tokens", "anchor")


def pages(spark, d):
    return adapters.tokens(spark, d)


def found(t):
    return tokens.anchors(t, FIELDS)


@query(sql("SELECT file_id, tok_seq, text, conf FROM tokens WHERE conf >= 30 AND trim(text) <> ''", "tokens"))
def confident_tokens(spark, d):
    return tokens.confident(pages(spark, d)).select("file_id", "tok_seq", "text", "conf")


@query(sql("SELECT file_id, max(x2) AS page_w, max(y2) AS page_h FROM tokens GROUP BY file_id", "tokens"))
def page_extent(spark, d):
    return tokens.page_extent(pages(spark, d))


@query(sql("SELECT * FROM anchor", "anchor"))
def anchor_lookup(spark, d):
    return found(pages(spark, d))


@query(sql(r"SELECT file_id, field, arg_min(text, (y - a_y2) * 100000000 + tok_seq) AS value FROM met WHERE y - a_y2 BETWEEN 0 AND 180 AND abs(cx - a_cx) <= 80 AND NOT regexp_matches(text, '^[\(\[][0-9]+[-–]?[0-9]*[\)\]]$') GROUP BY ALL", "met"))
def value_below(spark, d):
    t = pages(spark, d)
    return tokens.value_below(t, found(t))


@query(sql("SELECT file_id, field, arg_min(text, (x - a_x2) * 100000000 + tok_seq) AS value FROM met WHERE x - a_x2 BETWEEN 0 AND 500 AND abs(cy - a_cy) <= 20 GROUP BY ALL", "met"))
def value_right(spark, d):
    t = pages(spark, d)
    return tokens.value_right(t, found(t))


_STRIPPED = "regexp_replace({0}, '^[{1}]+|[{1}]+$', '', 'g')"
_WORD = _STRIPPED.format("upper(text)", " :.")
_NOISE = " OR ".join(f"contains({_WORD}, '{n}')" for n in tokens.NOISE)
_TEXT = _STRIPPED.format("text", " :.")
_BARE = _STRIPPED.format("text", ":")
_LINE = _STRIPPED.format("string_agg(text, ' ' ORDER BY x, y, tok_seq)", " :")


@query(sql(f"""SELECT file_id, field, nullif({_LINE}, '') AS value
FROM (SELECT *, min(y) OVER (PARTITION BY file_id, field) AS top FROM met WHERE y - a_y2 > 0 AND y - a_y2 <= 140 AND cx BETWEEN a_x - 40 AND a_x + 440 AND NOT ({_NOISE}) AND {_WORD} NOT IN ('POR', ''))
WHERE abs(y - top) < 25 GROUP BY ALL""", "met"))
def line_below(spark, d):
    t = pages(spark, d)
    return tokens.line_below(t, found(t))


@query(sql(f"""SELECT file_id, field, nullif(trim(string_agg({_BARE}, ' ' ORDER BY x, tok_seq)), '') AS value
FROM met WHERE x - a_x2 BETWEEN 0 AND 600 AND abs(cy - a_cy) <= 25 AND {_TEXT} NOT IN ('', '-') GROUP BY ALL""", "met"))
def line_right(spark, d):
    t = pages(spark, d)
    return tokens.line_right(t, found(t))


block("grouped", "SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY cy, tok_seq) AS row FROM (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY file_id ORDER BY cy, tok_seq) >= 22 THEN 1 ELSE 0 END AS new FROM tokens)", "tokens")


@query(sql("SELECT file_id, tok_seq, CAST(row AS BIGINT) AS row FROM grouped", "grouped"))
def row_grouping(spark, d):
    return tokens.group_rows(pages(spark, d)).select("file_id", "tok_seq", "row")


_BUCKET = "CASE WHEN cx / page_w < 0.10 THEN 'idem' WHEN cx / page_w < 0.25 THEN 'codigo' WHEN cx / page_w < 0.60 THEN 'nombre_producto' WHEN cx / page_w < 0.72 THEN 'presentacion' WHEN cx / page_w < 0.86 THEN 'cant_solicitada' WHEN cx / page_w < 1.0 THEN 'cant_despachada' END"


@query(sql(f"SELECT file_id, tok_seq, {_BUCKET} AS col FROM tokens JOIN (SELECT file_id, max(x2) AS page_w FROM tokens GROUP BY file_id) USING (file_id)", "tokens"))
def column_buckets(spark, d):
    t = pages(spark, d)
    sized = t.join(tokens.page_extent(t), "file_id")
    return sized.select("file_id", "tok_seq", tokens.column_of(forms.default_layout(), F.col("cx") / F.col("page_w")).alias("col"))


@query(sql("""SELECT file_id, tok_seq FROM (SELECT g.file_id, g.row, g.tok_seq, max(foot) OVER (PARTITION BY g.file_id ORDER BY g.row) AS footed FROM grouped g
JOIN (SELECT file_id, row, max(CASE WHEN contains(upper(text), 'SHTH') THEN 1 ELSE 0 END) AS foot FROM grouped GROUP BY ALL) f ON f.file_id = g.file_id AND f.row = g.row) WHERE footed = 0""", "grouped"))
def footer_stop(spark, d):
    from pyspark.sql import Window as W

    rows = tokens.group_rows(pages(spark, d)).withColumn("foot", F.contains(F.upper("text"), F.lit("SHTH")))
    return rows.withColumn("footed", F.max("foot").over(W.partitionBy("file_id").orderBy("row"))).where("not footed").select("file_id", "tok_seq")


# ---- forms made from order lines: what was put on them must come back
block("form_line", "SELECT *, o * 100 + (rn - 1) // 20 AS file_id, (rn - 1) % 20 AS spot FROM line", "line")
block("form", "SELECT file_id, any_value(o) AS o, count(*) AS n FROM form_line GROUP BY file_id", "form_line")


def form(spark, d):
    return adapters.form_tokens(spark, d)


def master(spark, d):
    return codes.material_master(table(spark, d, "part").select((F.col("p_partkey") + 910000000).alias("Codigo")))


@query(sql("""SELECT file_id, '201' AS mov, 'A' || (o % 5) AS almacen, 'D' || (o % 7) AS depend_destinataria, 'L' || (o % 11) AS lote, '1996' AS "año", CAST(1 + o % 12 AS VARCHAR) AS mes, CAST(n AS VARCHAR) AS total_despachada, '0' AS total_no_despachada FROM form""", "form"))
def extract_header(spark, d):
    return forms.extract_header(form(spark, d))


@query(sql("""SELECT file_id, 'Ana Paz' AS solicito, CAST(NULL AS VARCHAR) AS autorizo, CAST(NULL AS VARCHAR) AS recibio, CAST(NULL AS VARCHAR) AS preparado_por, CAST(NULL AS VARCHAR) AS comprobado_por, 'Luis' AS elaborado FROM form""", "form"))
def extract_signatures(spark, d):
    return forms.extract_signatures(form(spark, d))


@query(sql("SELECT file_id, CAST(4930000000 + o * 100 AS VARCHAR) AS no_doc FROM form", "form"))
def document_number(spark, d):
    return forms.document_number(form(spark, d))


@query(sql("""SELECT file_id, col, lo, hi FROM form, (VALUES ('idem', 0.0, 0.11), ('codigo', 0.11, 0.245), ('nombre_producto', 0.245, 0.485), ('presentacion', 0.485, 0.705), ('cant_solicitada', 0.705, 0.83), ('cant_despachada', 0.83, 0.9575)) c(col, lo, hi)""", "form"))
def detect_columns(spark, d):
    near = lambda c: F.round(c, 6).alias(c)
    return forms.detect_columns(form(spark, d)).select("file_id", F.inline("layout")).select("file_id", "col", near("lo"), near("hi"))


@query(sql("""SELECT file_id, codigo, CAST(spot + 1 AS VARCHAR) AS idem, translate(name, ' ', '_') AS nombre_producto, 'UN' AS presentacion, CAST(CAST(qty + 1 AS BIGINT) AS VARCHAR) AS cant_solicitada,
CASE WHEN seq % 6 = 5 THEN '' ELSE CAST(CAST(qty AS BIGINT) AS VARCHAR) END AS cant_despachada, CAST(360 + 40 * spot AS INTEGER) AS box_y1, CAST(380 + 40 * spot AS INTEGER) AS box_y2, true AS verified
FROM (SELECT *, CAST(code AS VARCHAR) AS codigo FROM form_line QUALIFY row_number() OVER (PARTITION BY file_id, code ORDER BY spot DESC) = 1)""", "form_line"))
def extract_items(spark, d):
    t = form(spark, d)
    return forms.page_items(t, master(spark, d)).select("file_id", "codigo", "idem", "nombre_producto", "presentacion", "cant_solicitada", "cant_despachada", "box_y1", "box_y2", "verified")


block("form_file", """SELECT file_id, o, CAST(4930000000 + o * 100 AS VARCHAR) AS doc, CASE o % 3 WHEN 0 THEN doc WHEN 1 THEN doc[5:10] END AS name, coalesce(name, 'scan') || '_' || file_id || '.pdf' AS archivo, sha256(CAST(file_id AS VARCHAR)) AS archivo_hash FROM form""", "form")
_ITEM = "SELECT file_id, CAST(code AS VARCHAR) AS codigo, CAST(spot + 1 AS VARCHAR) AS idem, translate(name, ' ', '_') AS nombre_producto, CAST(CAST(qty + 1 AS BIGINT) AS VARCHAR) AS cant_solicitada, {0} AS cant_despachada FROM form_line WHERE (seq % {1} <> 0 OR spot = 0) QUALIFY row_number() OVER (PARTITION BY file_id, code ORDER BY spot DESC) = 1"
block("at_low", _ITEM.format("CASE WHEN seq % 6 = 5 THEN '' ELSE CAST(CAST(qty AS BIGINT) AS VARCHAR) END", 11), "form_line")
block("at_high", _ITEM.format("CAST(CAST(qty AS BIGINT) AS VARCHAR)", 13), "form_line")
_BEST = "CASE WHEN coalesce(l.{0}, '') = '' THEN h.{0} WHEN h.{0} IS NULL OR length(l.{0}) <= length(h.{0}) THEN l.{0} ELSE h.{0} END AS {0}"
block("on_forms", f"SELECT file_id, codigo, coalesce(l.idem, h.idem) AS idem, coalesce(l.nombre_producto, h.nombre_producto) AS nombre_producto, {_BEST.format('cant_solicitada')}, {_BEST.format('cant_despachada')} FROM at_low l FULL JOIN at_high h USING (file_id, codigo)", "at_low", "at_high")


@query(sql("""SELECT archivo, archivo_hash, doc AS no_doc, doc AS no_doc_ocr_local, name AS no_doc_archivo, CASE o % 3 WHEN 0 THEN 'OCR local + nombre archivo' WHEN 1 THEN 'OCR local (número completo)' ELSE 'OCR local' END AS no_doc_fuente, name = doc AS no_doc_coincide_archivo,
'201' AS mov, CAST(1 + o % 12 AS VARCHAR) AS mes, 'Ana Paz' AS solicito, codigo, idem, nombre_producto, cant_solicitada, coalesce(cant_despachada, CASE WHEN codigo IS NOT NULL THEN '' END) AS cant_despachada, CAST(NULL AS VARCHAR) AS error FROM form_file LEFT JOIN on_forms USING (file_id)""", "form_file", "on_forms"))
def process_forms(spark, d):
    line = keep(adapters.lines(spark, d), "line")
    done = documents.process_documents(adapters.form_files(spark, d, line), adapters.form_pages(spark, d, line), master(spark, d))
    return done.select("archivo", "archivo_hash", "no_doc", "no_doc_ocr_local", "no_doc_archivo", "no_doc_fuente", "no_doc_coincide_archivo", "mov", "mes", "solicito", "codigo", "idem", "nombre_producto", "cant_solicitada", "cant_despachada", "error")


@query("""SELECT p_partkey AS file_id, '' AS idem, 'Papel bond' AS nombre_producto, '' AS presentacion, CAST(910000000 + p_partkey AS VARCHAR) AS codigo, q AS cant_solicitada, q AS cant_despachada, 340 AS box_y1, 360 AS box_y2, true AS verified
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 900 + 1) || '500' WHEN 1 THEN CAST(p_partkey % 50 + 1 AS VARCHAR) ELSE CAST(p_partkey % 70 + 1 AS VARCHAR) END AS q FROM part)""")
def warehouse_receipt(spark, d):
    return forms.page_items(adapters.receipt_tokens(spark, d), master(spark, d))


# ---- codes
_READING = "CASE p_partkey % 7 WHEN 0 THEN '9100 ' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') WHEN 1 THEN 'x 0' || substr(CAST(910000000 + p_partkey AS VARCHAR), 2) WHEN 2 THEN '100' || lpad(CAST(p_partkey AS VARCHAR), 6, '9') WHEN 3 THEN '12345' WHEN 4 THEN '223' || lpad(CAST(p_partkey AS VARCHAR), 6, '2') WHEN 5 THEN '' ELSE '1234567' END"


@query(f"""SELECT k, raw, CASE k % 7 WHEN 0 THEN CAST(910000000 + k AS VARCHAR) WHEN 1 THEN CAST(910000000 + k AS VARCHAR) WHEN 2 THEN '100' || lpad(CAST(k AS VARCHAR), 6, '9') WHEN 4 THEN '223' || lpad(CAST(k AS VARCHAR), 6, '2') WHEN 6 THEN '1234567' END AS codigo,
k % 7 IN (0, 1) AS verified FROM (SELECT p_partkey AS k, {_READING} AS raw FROM part)""")
def clean_codigo(spark, d):
    read = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr(_READING.replace("VARCHAR", "STRING")).alias("raw"))
    return codes.clean_codes(read, ["k", "raw"], "raw", master(spark, d))


block("wrong", "SELECT k, i, s FROM (SELECT p_partkey AS k, CAST(910000000 + p_partkey * 7 AS VARCHAR) AS s, unnest(range(1, 10)) AS i FROM part)")
block("tried", "SELECT k, s, i, j, substr(s, 1, i - 1) || substr(o, j, 1) || substr(s, i + 1) AS c FROM (SELECT k, s, i, o, unnest(range(1, length(o) + 1)) AS j FROM (SELECT *, (MAP {'0': '9863', '1': '7', '2': '', '3': '85', '4': '9', '5': '638', '6': '805', '7': '1', '8': '063', '9': '048'})[substr(s, i, 1)] AS o FROM wrong))", "wrong")


@query(sql("SELECT k, arg_min(c, i * 10 + j) AS codigo FROM tried WHERE c IN (SELECT CAST(910000000 + p_partkey AS VARCHAR) FROM part) GROUP BY k", "tried"))
def recover_codigo(spark, d):
    wrong = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7 + 910000000).cast("string").alias("code"))
    return codes.recover_codes(wrong, ["k"], "code", master(spark, d))


# ---- readings
_A = "CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(l_partkey % 300 AS VARCHAR) END"
_B = "CASE l_suppkey % 4 WHEN 0 THEN '' ELSE CAST(l_suppkey % 70 * 11 AS VARCHAR) END"
block("reading", f"SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, {_A} AS a, {_B} AS b, CAST(l_linenumber % 3 * l_partkey AS VARCHAR) AS c FROM lineitem")


def readings(spark, d):
    e = lambda t: F.expr(t.replace("VARCHAR", "STRING"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), e(_A).alias("a"), e(_B).alias("b"), (F.col("l_linenumber") % 3 * F.col("l_partkey")).cast("string").alias("c"))


_DIG = "regexp_matches({0}, '^[0-9]+$')"
_NEEDS = f"(NOT {_DIG.format('a')} OR length(a) >= 4 OR NOT {_DIG.format('b')} OR a <> b)"


@query(sql(f"SELECT *, CASE WHEN {_DIG.format('a')} AND {_DIG.format('b')} THEN CASE WHEN length(a) <= length(b) THEN a ELSE b END WHEN {_DIG.format('a')} THEN a WHEN {_DIG.format('b')} THEN b WHEN a <> '' THEN a ELSE b END AS best FROM reading", "reading"))
def pick_best_cantidad(spark, d):
    return readings(spark, d).withColumn("best", pick_best_quantity(F.col("a"), F.col("b")))


@query(sql(f"SELECT *, {_NEEDS} AS again FROM reading", "reading"))
def needs_refinement_flag(spark, d):
    return readings(spark, d).withColumn("again", needs_refinement(F.col("a"), F.col("b")))


@query(sql(f"SELECT *, CASE WHEN {_DIG.format('c')} AND {_NEEDS} AND (NOT {_DIG.format('a')} OR length(c) < length(a) OR (length(c) = length(a) AND NOT {_DIG.format('b')})) THEN c ELSE a END AS taken FROM reading", "reading"))
def accept_local_reading(spark, d):
    return readings(spark, d).withColumn("taken", accept_local_cell(F.col("a"), F.col("c"), F.col("b")))


_R = "CASE l_linenumber % 4 WHEN 0 THEN (l_partkey % 999 + 1) || ',500' WHEN 1 THEN l_partkey || '.0' WHEN 2 THEN l_partkey || '.25' ELSE ' ' || l_partkey || ' ' END"


@query(f"SELECT o, l, t, CASE l % 4 WHEN 0 THEN (p % 999 + 1) || '500' WHEN 1 THEN CAST(p AS VARCHAR) WHEN 2 THEN p || '.25' ELSE CAST(p AS VARCHAR) END AS q FROM (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, {_R} AS t FROM lineitem)")
def receipt_quantity_text(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.expr(_R).alias("t")).withColumn("q", receipt_quantity(F.col("t")))


# ---- document numbers
_FULL = "CAST(4930000000 + o_orderkey AS VARCHAR)"
_N = f"CASE o_orderkey % 4 WHEN 0 THEN {_FULL} WHEN 1 THEN right({_FULL}, 6) WHEN 2 THEN CAST(4930000000 + o_orderkey + 10 AS VARCHAR) END"
_L = f"CASE o_orderkey % 5 WHEN 0 THEN {_FULL} WHEN 1 THEN CAST(4930000000 + o_orderkey + 1 AS VARCHAR) WHEN 2 THEN '4811111111' WHEN 3 THEN right({_FULL}, 8) END"
_M = f"CASE o_orderkey % 7 WHEN 0 THEN {_FULL} WHEN 1 THEN '4811111111' WHEN 2 THEN right({_FULL}, 6) WHEN 3 THEN {_L} WHEN 4 THEN CAST(4930000000 + o_orderkey + 10 AS VARCHAR) END"
block("trio", f"SELECT o_orderkey AS k, {_N} AS n, {_L} AS l, {_M} AS m FROM orders")
block("decided", """SELECT *, CASE
WHEN m = l AND n IS NOT NULL AND NOT (ends_with(m, n) OR ends_with(n, m)) AND (length(n) <> length(m) OR hamming(CASE WHEN length(n) = length(m) THEN n ELSE m END, m) > 2) THEN 1
WHEN m = l THEN 2
WHEN length(l) > length(n) AND ends_with(l, n) AND m IS NULL THEN 3
WHEN length(l) > length(n) AND ends_with(l, n) AND ends_with(l, m) THEN 4
WHEN length(m) > length(n) AND ends_with(m, n) AND l IS NULL THEN 5
WHEN length(m) > length(n) AND ends_with(m, n) AND NOT (length(l) >= length(n) AND ends_with(l, n)) THEN 6
WHEN m = n THEN 7 WHEN l = n THEN 8 WHEN m IS NOT NULL AND n IS NOT NULL THEN 9 WHEN m IS NOT NULL THEN 10 WHEN l IS NULL THEN 11
WHEN n IS NOT NULL AND length(n) = length(l) AND hamming(CASE WHEN length(n) = length(l) THEN n ELSE l END, l) = 1 THEN 12 ELSE 13 END AS r FROM trio""", "trio")
_SOURCES = ["nombre archivo (descarta lectura sospechosa)", "gemini + OCR local", "OCR local (número completo)", "OCR local (número completo, Gemini abreviado)", "gemini (número completo)", "gemini (número completo, OCR local incoherente)", "gemini + nombre archivo", "OCR local + nombre archivo", "nombre archivo (Gemini sin consenso)", "gemini", "nombre_archivo", "nombre archivo (corrige OCR)", "OCR local"]
_LIST = ", ".join(f"'{s}'" for s in _SOURCES)


@query(sql(f"SELECT k, n, l, m, CASE WHEN r IN (1, 9, 11, 12) THEN n WHEN r IN (3, 4, 8, 13) THEN l ELSE m END AS no_doc, [{_LIST}][r] AS source, CASE WHEN m IS NOT NULL AND l IS NOT NULL THEN m = l END AS agree FROM decided", "decided"))
def resolve_number(spark, d):
    e = lambda t: F.expr(t.replace("VARCHAR", "STRING"))
    trio = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), e(_N).alias("n"), e(_L).alias("l"), e(_M).alias("m"))
    done = trio.withColumn("r", resolve_doc_number(F.col("n"), F.col("l"), F.col("m")))
    return done.select("k", "n", "l", "m", "r.no_doc", "r.source", agreement(F.col("m"), F.col("l")).alias("agree"))


# ---- two resolutions, and replies of an outside model
block("low", "SELECT file_id, CAST(code AS VARCHAR) AS codigo, max(seq) AS row_seq, arg_max(CASE WHEN seq % 4 = 0 THEN '' ELSE CAST(CAST(qty AS BIGINT) AS VARCHAR) END, seq) AS cant_despachada FROM form_line WHERE seq % 3 <> 0 GROUP BY ALL", "form_line")
block("high", "SELECT file_id, CAST(code AS VARCHAR) AS codigo, max(seq) AS row_seq, arg_max(CAST(CAST(qty + 5 AS BIGINT) AS VARCHAR), seq) AS cant_despachada FROM form_line WHERE seq % 5 <> 0 GROUP BY ALL", "form_line")


def two_readings(spark, d):
    line = adapters.form_lines(spark, d).select("file_id", F.col("code").cast("string").alias("codigo"), F.col("seq").alias("row_seq"), "qty")
    whole = lambda c: c.cast("bigint").cast("string")
    low = line.where("row_seq % 3 <> 0").withColumn("cant_despachada", F.when(F.col("row_seq") % 4 == 0, "").otherwise(whole(F.col("qty"))))
    high = line.where("row_seq % 5 <> 0").withColumn("cant_despachada", whole(F.col("qty") + 5))
    return extraction.last_reading(low), extraction.last_reading(high)


@query(sql("SELECT file_id, codigo, CASE WHEN low.codigo IS NOT NULL THEN low.cant_despachada ELSE high.cant_despachada END AS cant_despachada FROM low FULL JOIN high USING (file_id, codigo)", "low", "high"))
def merge_resolutions(spark, d):
    return extraction.merge_resolutions(*two_readings(spark, d), fields=("cant_despachada",))


# replies: the first holds all lines, the second two thirds, with some quantities changed
block("claims", """SELECT file_id, 0 AS reply, spot AS place, CAST(code AS VARCHAR) AS codigo, '' AS cant_solicitada, CASE WHEN seq % 9 = 0 THEN '' ELSE CAST(CAST(qty AS BIGINT) AS VARCHAR) END AS cant_despachada FROM form_line
UNION ALL SELECT file_id, 1, spot, CAST(code AS VARCHAR), '7', CAST(CAST(qty + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR) FROM form_line WHERE seq % 3 <> 0""", "form_line")
block("agreed", """SELECT file_id, codigo, arg_min(cant_solicitada, reply * 1000 + place) AS cant_solicitada, arg_min(cant_despachada, reply * 1000 + place) AS cant_despachada FROM claims GROUP BY ALL
HAVING count(*) >= 2 AND count(DISTINCT nullif(cant_despachada, '')) = 1""", "claims")
block("complete", "SELECT c.file_id, reply FROM claims c JOIN form USING (file_id) GROUP BY ALL HAVING count(*) >= greatest(3, ceil(any_value(n) * 0.7))", "claims", "form")
block("confirmed", """SELECT * FROM agreed UNION ALL
SELECT file_id, codigo, arg_min(s, reply), arg_min(q, reply) FROM (SELECT file_id, reply, codigo, arg_min(cant_solicitada, place) AS s, arg_min(cant_despachada, place) AS q FROM claims GROUP BY ALL)
WHERE q <> '' AND (file_id, reply) IN (SELECT (file_id, reply) FROM complete) AND (file_id, codigo) NOT IN (SELECT (file_id, codigo) FROM agreed) GROUP BY ALL""", "agreed", "complete", "claims")


def model_claims(spark, d):
    line = adapters.form_lines(spark, d)
    whole = lambda c: c.cast("bigint").cast("string")
    base = [F.col("file_id"), F.col("at").alias("place"), F.col("code").cast("string").alias("codigo")]
    first = line.select(*base, F.lit(0).alias("reply"), F.lit("").alias("cant_solicitada"), F.when(F.col("seq") % 9 == 0, "").otherwise(whole(F.col("qty"))).alias("cant_despachada"))
    second = line.where("seq % 3 <> 0").select(*base, F.lit(1).alias("reply"), F.lit("7").alias("cant_solicitada"), whole(F.col("qty") + (F.col("seq") % 7 == 0).cast("int")).alias("cant_despachada"))
    return first.unionByName(second), line.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT * FROM confirmed", "confirmed"))
def consensus_rows(spark, d):
    return extraction.consensus(*model_claims(spark, d))


@query(sql("SELECT file_id, codigo, CASE WHEN c.codigo IS NOT NULL THEN c.cant_solicitada END AS cant_solicitada, CASE WHEN c.codigo IS NOT NULL THEN c.cant_despachada ELSE low.cant_despachada END AS cant_despachada FROM low FULL JOIN confirmed c USING (file_id, codigo)", "low", "confirmed"))
def upsert_confirmed(spark, d):
    low, _ = two_readings(spark, d)
    items = low.select("file_id", "codigo", F.lit(None).cast("string").alias("cant_solicitada"), "cant_despachada")
    return extraction.upsert(items, extraction.consensus(*model_claims(spark, d)))


_JSON = """CASE o_orderkey % 4 WHEN 0 THEN '[{"codigo":"' || (910000000 + o_orderkey) || '","cant_despachada":' || (o_orderkey % 50) || '},7,{"codigo":"12"}]' WHEN 1 THEN '[{"codigo":"' || (910000000 + o_orderkey) || '","cant_solicitada":"4","cant_despachada":null}]' WHEN 2 THEN 'not json' ELSE '[]' END"""


@query("""SELECT o_orderkey AS file_id, 0 AS reply, 0 AS place, CAST(910000000 + o_orderkey AS VARCHAR) AS codigo, CASE WHEN o_orderkey % 4 = 1 THEN '4' ELSE '' END AS cant_solicitada,
CASE WHEN o_orderkey % 4 = 1 THEN 'None' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS cant_despachada FROM orders WHERE o_orderkey % 4 IN (0, 1)""")
def parse_llm_json(spark, d):
    replies = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit(0).alias("reply"), F.expr(_JSON).alias("text"))
    return extraction.parse_replies(replies)


@query("SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS cell, CASE WHEN length(CAST(event_id AS VARCHAR)) = 4 AND event_id % 3 > 0 THEN CAST(event_id AS VARCHAR) END AS four FROM events")
def clean_llm_cell(spark, d):
    reply = F.when(F.col("event_id") % 3 == 0, "vacio.").otherwise(F.concat(F.lit("n: "), F.col("event_id"), F.lit(" u")))
    return table(spark, d, "events").select(F.col("event_id").alias("k"), extraction.clean_cell(reply).alias("cell"), extraction.exact_digits(reply, 4).alias("four"))
