"""Queries over the ledger and the scan, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clean_id, date_from_filename, date_range_from_filename, filename_doc, is_digits, normal_text, one_edit_apart, to_number, token_overlap
from ..operators import dedup, reconcile, repair, report
from ..sources import adapters
from ..sources.adapters import ledger, scan, table
from ..sources.scratch import keep
from .sql import block, sql, to_number as sql_number

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def prepared(spark, d):
    return reconcile.prepare_ledger(ledger(spark, d)), reconcile.with_keys(scan(spark, d))


def written(spark, d):
    """Ledger and scan over order lines that are written once."""
    line = keep(adapters.lines(spark, d), "line")
    return ledger(spark, d, line), scan(spark, d, line)


def copies(spark, d):
    return reconcile.cleaned(*written(spark, d))


def merged(spark, d):
    """The comparison with codes corrected by one edit only, which SQL can follow."""
    return reconcile.compare(*written(spark, d), fuzzy=False)


MERGED = ("estado", "no_doc", "codigo", "cant_despachada_ext", "cant_despachada_esc", "nombre_producto_ext", "nombre_producto_esc", "presentacion_ext", "presentacion_esc", "fecha", "archivo")


@query(sql("SELECT CAST(4930000000 + o * 100 AS VARCHAR) AS no_doc, CAST(code AS VARCHAR) AS codigo, name AS nombre_producto, type AS presentacion, day AS fecha, abs(-qty) AS cant_despachada, seq AS row_seq FROM line", "line"))
def normalize_ledger(spark, d):
    return reconcile.normalize_ledger(adapters.raw_ledger(spark, d)).select("no_doc", "codigo", "nombre_producto", "presentacion", "fecha", "cant_despachada", "row_seq")


@query(sql("SELECT 'ext' AS side, no_doc, codigo, q, row_seq FROM ledger1 WHERE q > 0 UNION ALL SELECT 'esc', no_doc, codigo, q, row_seq FROM scan1 WHERE q IS NULL OR q <> 0", "ledger1", "scan1"))
def clean_keys_filter(spark, d):
    listed, seen = prepared(spark, d)
    pick = lambda df, side: df.select(F.lit(side).alias("side"), "no_doc", "codigo", "q", "row_seq")
    return pick(reconcile.dispatched(listed), "ext").unionByName(pick(reconcile.not_zero(seen), "esc"))


_QUANTITY = "CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'abc' WHEN 3 THEN ' ' || o_orderkey || '.50 ' WHEN 4 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 5 THEN '| ' || o_orderkey WHEN 6 THEN '1d' WHEN 7 THEN '.5e1' ELSE CAST(o_orderkey AS VARCHAR) || '.' END"


@query(f"SELECT k, t, {sql_number('t')} AS n FROM (SELECT o_orderkey AS k, {_QUANTITY} AS t FROM orders)")
def to_number_parse(spark, d):
    k = F.col("o_orderkey")
    text = F.expr(_QUANTITY.replace("VARCHAR", "STRING"))
    return table(spark, d, "orders").select(k.alias("k"), text.alias("t")).withColumn("n", to_number(F.col("t")))


@query(sql("SELECT archivo, no_doc, codigo, row_seq FROM physical", "physical"))
def physical_dedup(spark, d):
    return dedup.physical_dedup(prepared(spark, d)[1]).select("archivo", "no_doc", "codigo", "row_seq")


@query(sql("SELECT archivo, no_doc, codigo, row_seq FROM best", "best"))
def best_copy(spark, d):
    return dedup.best_copy(dedup.physical_dedup(prepared(spark, d)[1])).select("archivo", "no_doc", "codigo", "row_seq")


@query(sql("SELECT no_doc, archivo, codigos, legibles, CAST(coincide AS INTEGER) AS coincide FROM copies", "copies"))
def copy_quality(spark, d):
    return dedup.copy_quality(dedup.physical_dedup(prepared(spark, d)[1]))


@query(sql("SELECT scanned, target, common, score FROM scored WHERE scanned = target", "scored"))
def overlap_score(spark, d):
    codes = keep(repair.code_sets(*copies(spark, d)), "codes")
    counts = repair.code_counts(codes)
    pairs = counts.where("n_seen > 0").select(F.col("no_doc").alias("scanned"), F.col("no_doc").alias("target"))
    return repair.overlap_scores(codes, counts, pairs)


@query(sql("SELECT * FROM candidates", "candidates"))
def doc_remap_candidates(spark, d):
    return repair.doc_candidates(*copies(spark, d))


@query(sql("SELECT no_doc, no_doc_original, codigo, row_seq FROM renumbered", "renumbered"))
def doc_remap(spark, d):
    return repair.renumber(*copies(spark, d))[0].select("no_doc", "no_doc_original", "codigo", "row_seq")


@query("SELECT a.p_partkey AS k, CAST(910000000 + a.p_partkey AS VARCHAR) AS a, CAST(910000000 + a.p_partkey * 3 AS VARCHAR) AS b, levenshtein(CAST(910000000 + a.p_partkey AS VARCHAR), CAST(910000000 + a.p_partkey * 3 AS VARCHAR)) = 1 AS one_edit FROM part a")
def one_edit(spark, d):
    k = F.col("p_partkey")
    pairs = table(spark, d, "part").select(k.alias("k"), (k + 910000000).cast("string").alias("a"), (k * 3 + 910000000).cast("string").alias("b"))
    return pairs.withColumn("one_edit", one_edit_apart(F.col("a"), F.col("b")))


@query(sql("SELECT no_doc, codigo, q, row_seq FROM scan3", "scan3"))
def code_repair_exact(spark, d):
    return reconcile.sides(*written(spark, d), fuzzy=False)[1].select("no_doc", "codigo", "q", "row_seq")


@query()
def code_repair_fuzzy(spark, d):
    return reconcile.sides(*written(spark, d))[1].select("no_doc", "codigo", "q", "row_seq")


_NORMAL = "array_to_string(regexp_extract_all(upper(translate(replace(coalesce({0}, ''), 'ß', 'SS'), 'ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑáàâäãåéèêëíìîïóòôöõúùûüçñ', 'AAAAAAEEEEIIIIOOOOOUUUUCNaaaaaaeeeeiiiiooooouuuucn')), '([A-Z0-9]+)', 1), ' ')"


@query(f"SELECT doc_id, md5({_NORMAL.format('text')}) AS normal FROM documents")
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normal_text(F.col("text"))).alias("normal"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(string_split({_NORMAL.format('text')}, ' ')) AS w, {_NORMAL.format('text')} = '' AS none FROM documents)
SELECT a.doc_id, CASE WHEN a.none OR b.none THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / greatest(1, least(len(a.w), len(b.w))) END AS overlap FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def token_overlap_next(spark, d):
    docs = table(spark, d, "documents").select("doc_id", normal_text(F.col("text")).alias("a"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return docs.join(following, "doc_id").select("doc_id", token_overlap(F.col("a"), F.col("b")).cast("double").alias("overlap"))


block("all_sum", "SELECT no_doc, codigo, coalesce(sum(q), 0) AS cant_despachada, arg_min(nombre_producto, row_seq) AS nombre_producto, arg_min(fecha, row_seq) AS fecha FROM ledger1 GROUP BY no_doc, codigo", "ledger1")


@query(sql("SELECT * FROM all_sum", "all_sum"))
def aggregate_by_key(spark, d):
    return reconcile.aggregate_by_key(prepared(spark, d)[0]).select("no_doc", "codigo", "cant_despachada", "nombre_producto", "fecha")


@query(sql("SELECT no_doc, codigo, row_seq FROM ledger1 WHERE no_doc IN (SELECT no_doc FROM scan1)", "ledger1", "scan1"))
def semi_join_ledger(spark, d):
    listed, seen = prepared(spark, d)
    return reconcile.of_scanned_documents(listed, seen).select("no_doc", "codigo", "row_seq")


block("replaced", "SELECT DISTINCT archivo FROM scan1 WHERE archivo LIKE 'copia%'", "scan1")


@query(sql("SELECT no_doc, codigo, row_seq FROM scan1 ANTI JOIN replaced USING (archivo)", "scan1", "replaced"))
def anti_join_replaced(spark, d):
    seen = prepared(spark, d)[1]
    replaced = seen.where(F.startswith("archivo", F.lit("copia"))).select("archivo").distinct()
    return seen.join(replaced, "archivo", "left_anti").select("no_doc", "codigo", "row_seq")


block("plain_ext", "SELECT no_doc, codigo, sum(q) AS q FROM ledger1 WHERE q > 0 GROUP BY ALL", "ledger1")
block("plain_esc", "SELECT no_doc, codigo, coalesce(sum(q), 0) AS q FROM scan1 WHERE q IS NULL OR q <> 0 GROUP BY ALL", "scan1")


@query(sql("""SELECT CASE WHEN e.q IS NULL THEN 'solo_escaneada' WHEN s.q IS NULL THEN 'solo_externa' WHEN abs(e.q - s.q) > 1e-6 THEN 'cant_despachada_difiere' ELSE 'ok' END AS estado,
no_doc, codigo, e.q AS cant_despachada_ext, s.q AS cant_despachada_esc FROM plain_ext e FULL JOIN plain_esc s USING (no_doc, codigo)""", "plain_ext", "plain_esc"))
def full_outer_diff(spark, d):
    listed, seen = prepared(spark, d)
    key = lambda df: reconcile.aggregate_by_key(df.select("no_doc", "codigo", "q", "row_seq"))
    return reconcile.full_outer_diff(key(reconcile.dispatched(listed)), key(reconcile.not_zero(seen)))


@query(sql("SELECT * FROM merged", "merged"))
def reconcile_exact(spark, d):
    return merged(spark, d).select(*MERGED)


@query()
def reconcile_all(spark, d):
    """As ``reconcile_exact``, with codes corrected by similarity too."""
    return reconcile.compare(*written(spark, d)).select(*MERGED)


QUERIES["reconcile"] = QUERIES.pop("reconcile_all")


@query(sql("SELECT * FROM summary", "summary"))
def doc_summary(spark, d):
    return report.summary_order(report.document_summary(merged(spark, d)))


_NAME = "CASE o_orderkey % 8 WHEN 0 THEN o_orderkey || '_05.03.2026.pdf' WHEN 1 THEN 'doc ' || o_orderkey || '_5-3-26.pdf' WHEN 2 THEN o_orderkey || '_05.0326.pdf' WHEN 3 THEN o_orderkey || '_31.02.2026.pdf' WHEN 4 THEN 'x-2025.pdf' WHEN 5 THEN 'x.pdf' WHEN 6 THEN o_orderkey || '-1999.pdf' ELSE lpad(CAST(o_orderkey AS VARCHAR), 8, '4') || '.' || (o_orderkey % 40) || '.07.24 b.pdf' END"
_LONG = r"'(?:^|[^0-9])([0-9]{1,2})[.-]([0-9]{1,2})[.-]([0-9]{4}|[0-9]{2})(?:[^0-9]|$)'"
_SHORT = r"'(?:^|[^0-9])([0-9]{1,2})[.-]([0-9]{2})([0-9]{2})(?:[^0-9]|$)'"


def _sql_day(pattern):
    y = f"regexp_extract(name, {pattern}, 3)"
    return f"TRY_CAST(CASE WHEN length({y}) = 2 THEN '20' || {y} ELSE {y} END || '-' || regexp_extract(name, {pattern}, 2) || '-' || regexp_extract(name, {pattern}, 1) AS DATE)"


_DAY = f"CASE WHEN regexp_matches(name, {_LONG}) THEN {_sql_day(_LONG)} WHEN regexp_matches(name, {_SHORT}) THEN {_sql_day(_SHORT)} END"
_YEAR_TEXT = "regexp_extract(name, '[.-]([0-9]{4}|[0-9]{2})[^0-9]*$', 1)"
_YEAR = f"TRY_CAST(CASE WHEN length({_YEAR_TEXT}) = 2 THEN '20' || {_YEAR_TEXT} ELSE {_YEAR_TEXT} END AS INTEGER)"


def _ranges(source):
    return f"""SELECT * EXCLUDE (day, year), coalesce(day, CASE WHEN year BETWEEN 2000 AND 2100 THEN make_date(year, 1, 1) END) AS start,
coalesce(day, CASE WHEN year BETWEEN 2000 AND 2100 THEN make_date(year, 12, 31) END) AS "end",
CASE WHEN day IS NOT NULL THEN strftime(day, '%d.%m.%Y') WHEN year BETWEEN 2000 AND 2100 THEN 'año ' || year END AS label
FROM (SELECT *, {_DAY} AS day, {_YEAR} AS year FROM ({source}))"""


def named_orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_NAME.replace("VARCHAR", "STRING")).alias("name"))


_NAMED = f"SELECT o_orderkey AS k, {_NAME} AS name FROM orders"


@query(f"SELECT k, name, {_DAY} AS day FROM ({_NAMED})")
def date_in_filename(spark, d):
    return named_orders(spark, d).withColumn("day", date_from_filename(F.col("name")))


@query(_ranges(_NAMED))
def date_range_in_filename(spark, d):
    found = named_orders(spark, d).withColumn("r", date_range_from_filename(F.col("name")))
    return found.select("k", "name", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.label").alias("label"))


@query(f"SELECT k, name, nullif(regexp_extract(name, '^([0-9]{{6,10}})', 1), '') AS doc FROM ({_NAMED})")
def doc_in_filename(spark, d):
    return named_orders(spark, d).withColumn("doc", filename_doc(F.col("name")))


block("files", "SELECT no_doc, archivo AS name, min(row_seq) AS seq FROM scan1 GROUP BY ALL", "scan1")
block("ranges", _ranges("SELECT * FROM files"), "files")
block("doc_dates", 'SELECT no_doc, arg_max(start, seq) AS start, arg_max("end", seq) AS "end", arg_max(label, seq) AS label FROM ranges WHERE start IS NOT NULL GROUP BY no_doc', "ranges")
block("coverage", "SELECT date_trunc('month', min(fecha)) AS lo, last_day(max(fecha)) AS hi FROM ledger1", "ledger1")
block("outside", """SELECT s.no_doc, label FROM summary s JOIN doc_dates USING (no_doc), coverage
WHERE s.no_doc NOT IN (SELECT no_doc FROM merged WHERE cant_despachada_ext IS NOT NULL) AND ("end" < lo OR start > hi)""", "summary", "doc_dates", "coverage", "merged")
block("mismatched", "SELECT DISTINCT no_doc FROM scan1 WHERE no_doc_archivo <> no_doc", "scan1")
block("tagged", """SELECT s.* REPLACE (CASE WHEN s.no_doc IN (SELECT no_doc FROM outside) THEN 'fuera de rango SAFISS' ELSE "diagnóstico" END
|| CASE WHEN s.no_doc IN (SELECT no_doc FROM mismatched) THEN '; número de archivo ≠ escaneo' ELSE '' END AS "diagnóstico") FROM summary s""", "summary", "outside", "mismatched")
block("one_file", "SELECT archivo, arg_min(archivo_hash, row_seq) AS archivo_hash, arg_min(no_doc, row_seq) AS no_doc FROM scan1 GROUP BY archivo", "scan1")


def whole_report(spark, d):
    listed, seen = written(spark, d)
    both = keep(reconcile.compare(listed, seen, fuzzy=False), "merged")
    seen, summary = reconcile.with_keys(seen), keep(report.document_summary(both), "summary")
    outside = keep(report.out_of_range(summary, both, seen, listed), "outside")
    flags = seen.withColumn("no_doc_coincide_archivo", F.col("no_doc_archivo") == F.col("no_doc"))
    return both, summary, outside, report.mismatched_documents(flags), seen


@query(sql("SELECT * FROM doc_dates", "doc_dates"))
def doc_dates_last(spark, d):
    return report.document_dates(prepared(spark, d)[1])


@query(sql("SELECT * FROM outside", "outside"))
def out_of_range(spark, d):
    return whole_report(spark, d)[2]


@query(sql("SELECT CASE WHEN no_doc IN (SELECT no_doc FROM outside) THEN 'fuera_rango' ELSE estado END AS estado, no_doc, codigo FROM merged", "merged", "outside"))
def state_override(spark, d):
    both, _, outside, _, _ = whole_report(spark, d)
    return report.tag_detail(both, outside).select("estado", "no_doc", "codigo")


@query(sql("SELECT * FROM tagged", "tagged"))
def mismatch_tags(spark, d):
    _, summary, outside, mismatched, _ = whole_report(spark, d)
    return report.tag_summary(summary, outside, mismatched)


@query(sql("""SELECT count(*) AS docs, count_if(ok = items) AS docs_ok, count_if(contains("diagnóstico", 'fuera de rango SAFISS')) AS docs_out, count_if(contains("diagnóstico", 'cantidad')) AS docs_diff,
count_if(contains("diagnóstico", 'faltan en SAFISS')) AS docs_faltan_safiss, count_if(contains("diagnóstico", 'faltan escaneadas')) AS docs_faltan_esc, (SELECT count(*) FROM one_file) AS files,
(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM one_file GROUP BY no_doc)) AS extra_copies, (SELECT count(*) FROM mismatched) AS docs_mismatch,
count(*) - count_if(ok = items) - count_if(contains("diagnóstico", 'fuera de rango SAFISS')) AS docs_bad, round(100 * count_if(ok = items) / greatest(count(*), 1), 6) AS pct_ok FROM tagged""", "tagged", "one_file", "mismatched"))
def kpi_totals(spark, d):
    _, summary, outside, mismatched, seen = whole_report(spark, d)
    return report.key_figures(report.tag_summary(summary, outside, mismatched), mismatched, seen)


@query(sql("SELECT archivo, archivo_hash, no_doc, count(*) OVER (PARTITION BY no_doc) AS copias FROM one_file QUALIFY copias > 1", "one_file"))
def duplicate_copies(spark, d):
    return report.duplicate_copies(prepared(spark, d)[1]).select("archivo", "archivo_hash", "no_doc", "copias")


@query(sql("SELECT estado, no_doc, codigo FROM merged WHERE estado = 'solo_externa'", "merged"))
def status_filter(spark, d):
    return report.status_filter(merged(spark, d), "solo_externa", only_bad=True).select("estado", "no_doc", "codigo")


@query(sql("SELECT estado, no_doc, codigo FROM merged WHERE estado <> 'ok'", "merged"))
def inconsistent_only(spark, d):
    return report.status_filter(merged(spark, d), only_bad=True).select("estado", "no_doc", "codigo")


@query(sql("SELECT estado, no_doc, codigo FROM merged WHERE regexp_matches(lower(no_doc), '4[0-3]00$') OR regexp_matches(lower(codigo), '4[0-3]00$')", "merged"))
def search_filter(spark, d):
    return report.search_filter(merged(spark, d), "4[0-3]00$").select("estado", "no_doc", "codigo")


@query(sql("""SELECT no_doc, contains("diagnóstico", 'cantidad') AS cantidad, contains("diagnóstico", 'faltan en SAFISS') AS falta_safiss, contains("diagnóstico", 'faltan escaneadas') AS falta_escaneo,
con_problemas > 0 AND NOT contains("diagnóstico", 'fuera de rango SAFISS') AS reprocesable FROM tagged""", "tagged"))
def diagnosis_buckets(spark, d):
    _, summary, outside, mismatched, _ = whole_report(spark, d)
    tagged = report.tag_summary(summary, outside, mismatched)
    again = report.reprocessable(tagged).select("no_doc", F.lit(True).alias("again"))
    flags = {"cantidad": "cantidad", "falta_safiss": "faltan en SAFISS", "falta_escaneo": "faltan escaneadas"}
    return tagged.join(again, "no_doc", "left").select("no_doc", *(report.contains("diagnóstico", t).alias(c) for c, t in flags.items()), F.coalesce("again", F.lit(False)).alias("reprocesable"))


@query(sql("SELECT no_doc, codigo, estado FROM merged ORDER BY no_doc, codigo LIMIT 25 OFFSET 75", "merged"))
def page_slice(spark, d):
    return report.page_slice(merged(spark, d).select("no_doc", "codigo", "estado"), ["no_doc", "codigo"], 3, 25)


@query(sql("""SELECT no_doc, codigo, CASE estado WHEN 'ok' THEN '✅ OK' WHEN 'solo_externa' THEN '⚠️ Solo en SAFISS' WHEN 'solo_escaneada' THEN '📄 Solo escaneada' ELSE '❌ ' || estado END AS etiqueta FROM merged""", "merged"))
def state_label(spark, d):
    return report.state_label(merged(spark, d)).select("no_doc", "codigo", "etiqueta")


@query(sql("SELECT DISTINCT archivo FROM scan1 WHERE no_doc IN (SELECT no_doc FROM summary WHERE con_problemas > 0)", "scan1", "summary"))
def failing_files(spark, d):
    _, summary, _, _, seen = whole_report(spark, d)
    return report.failing_files(seen, summary)


@query(sql("""SELECT archivo, no_doc, codigo, CASE WHEN archivo LIKE 'copia%' THEN 'nuevo' END AS nota FROM scan1""", "scan1"))
def reprocess_replace(spark, d):
    seen = prepared(spark, d)[1].select("archivo", "no_doc", "codigo")
    return report.replace_rows(seen, seen.where(F.startswith("archivo", F.lit("copia"))).withColumn("nota", F.lit("nuevo")))


@query(sql("SELECT no_doc, min_by(archivo, row_seq) AS archivo FROM scan1 WHERE archivo IS NOT NULL GROUP BY no_doc", "scan1"))
def document_path(spark, d):
    return prepared(spark, d)[1].where("archivo is not null").groupBy("no_doc").agg(F.min_by("archivo", "row_seq").alias("archivo"))


@query(sql("SELECT count(DISTINCT nullif(no_doc, '')) AS docs, count(DISTINCT archivo) AS files, count_if(regexp_matches(codigo, '^[0-9]+$')) AS codes FROM scan1", "scan1"))
def live_counts(spark, d):
    seen = prepared(spark, d)[1]
    return seen.agg(F.count_distinct(F.nullif(clean_id(F.col("no_doc")), F.lit(""))).alias("docs"), F.count_distinct("archivo").alias("files"), F.count_if(is_digits(F.col("codigo"))).alias("codes"))
