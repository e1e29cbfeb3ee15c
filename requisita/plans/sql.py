"""SQL blocks.  ``sql(final, *names)`` puts the named blocks, with what they
need, before a final SELECT."""

from __future__ import annotations

BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {}


def block(name: str, body: str, *needs: str) -> None:
    BLOCKS[name] = (body, needs)


def sql(final: str, *names: str) -> str:
    order: list[str] = []

    def add(name):
        for need in BLOCKS[name][1]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][0]})" for n in order) + "\n" + final if order else final


NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def to_number(c: str) -> str:
    s = rf"regexp_replace(regexp_replace({c}, '[,|]', '', 'g'), '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches({s}, {NUM}) THEN TRY_CAST({s} AS DOUBLE) END"


block("line", """
SELECT l_orderkey AS o, rn, l_orderkey * 1000 + rn AS seq, l_partkey + 910000000 AS code, l_quantity AS qty, p_name AS name, p_type AS type, CAST(l_shipdate AS DATE) AS day
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem)
JOIN part ON p_partkey = l_partkey""")

block("ledger", """
SELECT CAST(4930000000 + o * 100 AS VARCHAR) AS no_doc, CAST(code AS VARCHAR) AS codigo, name AS nombre_producto, type AS presentacion, day AS fecha, CAST(-qty AS VARCHAR) AS cant_despachada, seq AS row_seq FROM line""", "line")

block("scan", """
SELECT ['', 'copia_', 'dup_'][copy + 1] || CAST(4930000000 + o * 100 AS VARCHAR)
         || CASE WHEN o % 5 = 4 THEN '-2025' WHEN o % 50 = 7 THEN '' ELSE '_' || lpad(CAST(1 + o % 28 AS VARCHAR), 2, '0') || '.' || lpad(CAST(1 + o % 12 AS VARCHAR), 2, '0') || '.1996' END || '.pdf' AS archivo,
       CASE WHEN copy = 1 THEN 'c' ELSE 'h' END || o AS archivo_hash,
       CAST(4930000000 + o * 100 + CASE WHEN o % 17 = 3 THEN 1 ELSE 0 END AS VARCHAR) AS no_doc,
       CASE WHEN o % 170 = 3 THEN CAST(4930000000 + o * 100 AS VARCHAR) END AS no_doc_ocr_local,
       CASE WHEN copy = 0 THEN CAST(4930000000 + o * 100 AS VARCHAR) END AS no_doc_archivo,
       CAST(code + CASE WHEN seq % 19 = 0 THEN 500000 WHEN seq % 23 = 0 THEN 10000000 ELSE 0 END AS VARCHAR) AS codigo,
       CASE WHEN o % 5 = 0 THEN upper(name) ELSE name END AS nombre_producto, 'UN' AS presentacion,
       CASE WHEN seq % 29 = 0 THEN NULL WHEN seq % 31 = 0 THEN '0' WHEN seq % 13 = 0 THEN CAST(CAST(qty + 1 AS BIGINT) AS VARCHAR)
            WHEN seq % 41 = 0 THEN '| ' || CAST(CAST(qty AS BIGINT) AS VARCHAR) ELSE CAST(CAST(qty AS BIGINT) AS VARCHAR) END AS cant_despachada,
       seq * 10 + copy AS row_seq
FROM line JOIN (VALUES (0), (1), (2)) c(copy) ON copy = 0 OR (copy = 1 AND o % 7 = 0 AND rn % 3 <> 0) OR (copy = 2 AND o % 37 = 0)
WHERE o % 10 <> 9 AND seq % 11 <> 0""", "line")

CLEAN = r"coalesce(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
block("scan1", f"""
SELECT * REPLACE ({CLEAN.format('no_doc')} AS no_doc, {CLEAN.format('codigo')} AS codigo), {to_number('cant_despachada')} AS q
FROM scan WHERE {CLEAN.format('no_doc')} <> '' AND {CLEAN.format('codigo')} <> ''""", "scan")
block("ledger1", f"""
SELECT * REPLACE ({CLEAN.format('no_doc')} AS no_doc, {CLEAN.format('codigo')} AS codigo), abs({to_number('cant_despachada')}) AS q
FROM ledger WHERE {CLEAN.format('no_doc')} <> '' AND {CLEAN.format('codigo')} <> ''""", "ledger")
block("physical", """
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY archivo_hash, no_doc, codigo ORDER BY row_seq) AS r FROM scan1) WHERE r = 1""", "scan1")
block("copies", """
SELECT no_doc, archivo, count(DISTINCT codigo) AS codigos, count(q) AS legibles, max(CASE WHEN coalesce(no_doc_archivo, '') = no_doc THEN 1 ELSE 0 END) AS coincide
FROM physical WHERE archivo IS NOT NULL GROUP BY no_doc, archivo""", "physical")
block("best", """
SELECT p.* FROM physical p JOIN (SELECT no_doc, archivo FROM copies QUALIFY row_number() OVER (PARTITION BY no_doc ORDER BY codigos DESC, legibles DESC, coincide DESC, archivo) = 1) USING (no_doc, archivo)""", "copies")
block("scan_sets", "SELECT DISTINCT no_doc, codigo FROM best WHERE q > 0", "best")
block("ledger_sets", "SELECT DISTINCT no_doc, codigo FROM ledger1", "ledger1")
block("sizes", "SELECT 's' AS side, no_doc, count(*) AS n FROM scan_sets GROUP BY no_doc UNION ALL SELECT 'l', no_doc, count(*) FROM ledger_sets GROUP BY no_doc", "scan_sets", "ledger_sets")
block("meets", """
SELECT s.no_doc AS scanned, l.no_doc AS target, count(*) AS common FROM scan_sets s JOIN ledger_sets l USING (codigo) GROUP BY ALL""", "scan_sets", "ledger_sets")
block("scored", """
SELECT scanned, target, common, common / greatest(a.n, b.n) AS score
FROM meets JOIN sizes a ON a.side = 's' AND a.no_doc = scanned JOIN sizes b ON b.side = 'l' AND b.no_doc = target""", "meets", "sizes")
block("own", """
SELECT a.no_doc AS scanned, coalesce(score, 0) AS own, EXISTS (SELECT 1 FROM ledger_sets l WHERE l.no_doc = a.no_doc) AS known
FROM sizes a LEFT JOIN scored s ON s.scanned = a.no_doc AND s.target = a.no_doc WHERE a.side = 's'""", "scored", "sizes", "ledger_sets")
block("candidates", """
SELECT scanned, target, score, own, known FROM scored s JOIN own USING (scanned)
WHERE own < 0.5 AND target <> scanned AND score >= 0.7 AND
      (CASE WHEN length(target) = length(scanned) THEN hamming(scanned, target) <= 1 ELSE ends_with(scanned, target) OR ends_with(target, scanned) END
       OR EXISTS (SELECT 1 FROM best b WHERE b.no_doc = scanned AND b.no_doc_ocr_local = target))""", "scored", "own", "best")
# no two scanned documents of these tables contend for one target
block("remap", """
SELECT scanned, target FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next FROM candidates WHERE NOT known OR score >= own + 0.3
                             WINDOW w AS (PARTITION BY scanned ORDER BY score DESC, target)) WHERE r = 1 AND (next IS NULL OR score - next >= 0.1)""", "candidates")
block("mapped", """
SELECT * REPLACE (coalesce(target, no_doc) AS no_doc), no_doc AS no_doc_original FROM best LEFT JOIN remap ON scanned = no_doc""", "best", "remap")
block("renumbered", """
SELECT * EXCLUDE (r, scanned, target) FROM (SELECT *, row_number() OVER (PARTITION BY no_doc, codigo ORDER BY no_doc <> no_doc_original, row_seq) AS r FROM mapped)
WHERE r = 1 OR NOT EXISTS (SELECT 1 FROM remap)""", "mapped", "remap")
block("ledger2", """
SELECT * FROM ledger1 WHERE q > 0 AND (no_doc IN (SELECT no_doc FROM renumbered) OR NOT EXISTS (SELECT 1 FROM renumbered))""", "ledger1", "renumbered")
block("scan2", "SELECT * FROM renumbered WHERE q IS NULL OR q <> 0", "renumbered")
block("repairs", """
SELECT s.row_seq, s.no_doc, s.codigo, s.q, l.codigo AS new_code
FROM scan2 s JOIN ledger2 l ON l.no_doc = s.no_doc AND abs(l.q - s.q) <= 1e-6 AND levenshtein(s.codigo, l.codigo) = 1
WHERE s.q > 0 AND regexp_matches(s.codigo, '^[0-9]+$') AND regexp_matches(l.codigo, '^[0-9]+$')
  AND NOT EXISTS (SELECT 1 FROM ledger2 x WHERE x.no_doc = s.no_doc AND x.codigo = s.codigo)""", "scan2", "ledger2")
block("repair", """
SELECT row_seq, new_code, EXISTS (SELECT 1 FROM scan2 x WHERE x.no_doc = a.no_doc AND x.codigo = a.new_code AND abs(x.q - a.q) <= 1e-6) OR
       row_number() OVER (PARTITION BY no_doc, new_code, q ORDER BY row_seq) > 1 AS gone
FROM (SELECT row_seq, any_value(no_doc) AS no_doc, any_value(q) AS q, any_value(new_code) AS new_code FROM repairs GROUP BY row_seq HAVING count(*) = 1) a""", "repairs", "scan2")
block("scan3", """
SELECT s.* REPLACE (coalesce(new_code, codigo) AS codigo) FROM scan2 s LEFT JOIN repair USING (row_seq) WHERE NOT coalesce(gone, false)""", "scan2", "repair")
block("ledger_sum", """
SELECT no_doc, codigo, coalesce(sum(q), 0) AS q, arg_min(nombre_producto, row_seq) AS nombre_producto, arg_min(presentacion, row_seq) AS presentacion, arg_min(fecha, row_seq) AS fecha
FROM ledger2 GROUP BY no_doc, codigo""", "ledger2")
block("scan_sum", """
SELECT no_doc, codigo, coalesce(sum(q), 0) AS q, arg_min(nombre_producto, row_seq) AS nombre_producto, arg_min(presentacion, row_seq) AS presentacion, arg_min(archivo, row_seq) AS archivo
FROM scan3 GROUP BY no_doc, codigo""", "scan3")
block("merged", """
SELECT CASE WHEN e.no_doc IS NULL THEN 'solo_escaneada' WHEN s.no_doc IS NULL THEN 'solo_externa' WHEN abs(e.q - s.q) > 1e-6 THEN 'cant_despachada_difiere' ELSE 'ok' END AS estado,
       no_doc, codigo, e.q AS cant_despachada_ext, s.q AS cant_despachada_esc, e.nombre_producto AS nombre_producto_ext, s.nombre_producto AS nombre_producto_esc,
       e.presentacion AS presentacion_ext, s.presentacion AS presentacion_esc, fecha, archivo
FROM ledger_sum e FULL JOIN scan_sum s USING (no_doc, codigo)""", "ledger_sum", "scan_sum")
block("summary", """
SELECT no_doc, count(*) AS items, count_if(estado = 'ok') AS ok, count_if(estado <> 'ok') AS con_problemas,
       CASE WHEN bool_and(estado = 'ok') THEN 'OK' ELSE coalesce(nullif(concat_ws(', ', CASE WHEN bool_or(estado LIKE '%difiere%') THEN 'cantidad ≠' END,
         CASE WHEN bool_or(estado = 'solo_externa') THEN 'faltan escaneadas' END, CASE WHEN bool_or(estado = 'solo_escaneada') THEN 'faltan en SAFISS' END), ''), 'revisar') END AS "diagnóstico"
FROM merged GROUP BY no_doc""", "merged")
