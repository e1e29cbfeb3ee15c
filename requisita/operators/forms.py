"""From tokens to the header, signatures and line items of a form."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ITEM_CODE, digits, receipt_quantity
from ..sources.scratch import keep
from .codes import clean_codes
from .dedup import first_of
from .pages import Pages, on_pages
from .tokens import PAGE, ROW_GAP, page_extent

#: Columns of a form without a readable heading, as shares of the width.
DEFAULT_LAYOUT = (("idem", 0.0, 0.10), ("codigo", 0.10, 0.25), ("nombre_producto", 0.25, 0.60), ("presentacion", 0.60, 0.72), ("cant_solicitada", 0.72, 0.86), ("cant_despachada", 0.86, 1.0))
#: Header fields and signatures, and the words that announce them.
HEADER = {"mov": ["MOV"], "almacen": ["ALMACEN"], "depend_destinataria": ["DEPEND"], "lote": ["LOTE"], "año": ["AÑO"], "ano": ["ANO"], "mes": ["MES"]}
SIGNATURES = {"solicito": ["SOLICITO"], "autorizo": ["AUTORIZO"], "recibio": ["RECIBIO"], "preparado_por": ["PREPARADO"], "comprobado_por": ["COMPROBADO"]}
QUANTITIES = ("cant_solicitada", "cant_despachada")
MIN_DIGIT_CONFIDENCE, WIDEST_DIGIT = 55, 0.9
#: Runs of digits, other signs, and codes, of words that are read in Python.
RUNS, REST, CODE = re.compile("[0-9]+"), re.compile("[^0-9]"), re.compile(ITEM_CODE)
LAYOUT_TYPE = "array<struct<col:string,lo:double,hi:double>>"


def default_layout() -> Column:
    return F.array(*[F.struct(F.lit(c).alias("col"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for c, lo, hi in DEFAULT_LAYOUT]).cast(LAYOUT_TYPE)


def schema_of(names) -> str:
    return ", ".join(f"`{n}` string" for n in names)


TOTALS = ("total_despachada", "total_no_despachada")
HEADER_FIELDS = [f for f in (*HEADER, *TOTALS) if f != "ano"]
SIGNATURE_FIELDS = [*SIGNATURES, "elaborado"]
ROWS = "rows array<struct<row int, part int, y1 double, y2 double, idem string, nombre_producto string, presentacion string, cant_solicitada string, cant_despachada string, marks array<struct<digits string, cy double, y double, y2 double>>, raw string>>"


def header(p: Pages) -> dict[str, list]:
    """Eight fields from the top of each page."""
    top, tags = p.cy <= p.h[p.page] * 0.15, p.tags()
    holds = lambda words: np.logical_and.reduce([p.holds(w) for w in words])
    found = {f: p.value_below(p.first(top & holds(words)), tags) for f, words in HEADER.items()}
    one, two = np.full(p.n, -1), np.full(p.n, -1)
    for page, heads in p.lines((p.cy < p.h[p.page] * 0.15) & p.holds("espach", p.low), p.cx):
        one[page], two[page] = heads[0], heads[1] if len(heads) > 1 else -1
    found |= {f: p.value_below(a, tags) for f, a in zip(TOTALS, (one, two), strict=True)}
    found["año"] = [b if a is None else a for a, b in zip(found["año"], found.pop("ano"), strict=True)]
    return found


def signatures(p: Pages) -> dict[str, list]:
    found = {f: p.line_below(p.first(np.logical_and.reduce([p.holds(w) for w in words]))) for f, words in SIGNATURES.items()}
    return found | {"elaborado": p.line_right(p.first(p.holds("ELABORADO")))}


def number(p: Pages) -> list[str | None]:
    """Digits on the right of ``DOC.``, else of ``SAFIS``."""
    plain = [[REST.sub("", t or "") for t in p.value_right(p.first(p.holds(mark)))] for mark in ("DOC.", "SAFIS")]
    return [next((t for t in both if len(t) >= 6), None) for both in zip(*plain, strict=True)]


def layouts(p: Pages) -> list[list[tuple[str, float, float]]]:
    """Column bounds of each page, inferred from the heading of the items."""
    named = {"product": p.holds("PRODUCTO"), "name": p.holds("NOMBRE"), "code": (p.holds("CODIGO") | p.holds("ÓDIGO")) & ~p.holds("CODIGOS"), "pack": p.holds("PRESEN"), "asked": p.holds("SOLICITAD"), "sent": p.holds("DESPACHAD"), "amount": p.holds("CANTIDAD")}
    out = [DEFAULT_LAYOUT] * p.n
    for page, words in p.lines(np.logical_or.reduce(list(named.values()))):
        of = lambda mark, words=words: [i for i in words if named[mark][i]]
        products, names = of("product"), of("name")
        plain = [i for i in names if not named["product"][i]]
        names = plain or [i for i in names if p.up[i].as_py().startswith("NOMBRE")]
        names = [i for i in names if any(abs(p.cy[i] - p.cy[k]) < 40 for k in products)]
        if not names:
            continue
        name = min(names, key=lambda i: (p.cy[i], p.seq[i]))
        near = lambda mark: [p.cx[i] for i in of(mark) if abs(p.cy[i] - p.cy[name]) < 80]
        code, pack, asked, sent = (next(iter(near(m)), None) for m in ("code", "pack", "asked", "sent"))
        if code is None:
            continue
        amounts, w = near("amount"), p.w[page]
        asked = min(amounts, default=None) if asked is None else asked
        sent = sent if sent is not None else max(amounts) if len(amounts) >= 2 else None if asked is None else asked + (w - asked) * 0.5
        centres = (("codigo", code), ("nombre_producto", p.cx[name]), ("presentacion", pack), ("cant_solicitada", asked), ("cant_despachada", sent))
        s = sorted((float(c / w), n, k) for n, (k, c) in enumerate(centres) if c is not None)
        edge = max(0.02, s[0][0] - 0.05)
        bounds = [("idem", 0.0, edge)]
        for i, (at, _, k) in enumerate(s):
            lo = edge if i == 0 else (s[i - 1][0] + at) / 2
            hi = (at + s[i + 1][0]) / 2 if i + 1 < len(s) else 1.0
            bounds.append((k, lo, min(hi, lo + (hi - lo) * 0.75) if k == "cant_despachada" else hi))
        out[page] = bounds
    return out


def pick_number(bucket: list[tuple], centre: float | None) -> str:
    """Digits nearest to a column's centre, of words (text, conf, x, y, x2, y2,
    cx) that are clear and not a cross read as a digit; '' if there are none."""
    best, least = "", None
    for text, conf, x, y, x2, y2, cx in bucket:
        if not conf >= MIN_DIGIT_CONFIDENCE:
            continue
        wide_one = y2 > y and (x2 - x) / (y2 - y) > WIDEST_DIGIT
        away = 0 if centre is None else abs(cx - centre)
        for run in RUNS.findall(text):
            if not (len(run) == 1 and wide_one) and (least is None or away < least):
                best, least = run, away
    return best


def region(p: Pages, columns: list) -> tuple[np.ndarray, np.ndarray]:
    """The words of the item tables by page and height, and whether a word is a code."""
    code = [next(((lo, hi) for c, lo, hi in page if c == "codigo"), (0.06, 0.25)) for page in columns]
    lo, hi = np.array([c[0] for c in code]), np.array([c[1] for c in code])
    doc = p.first(p.holds("DOC.") & (p.cy >= p.h[p.page] * 0.5) & (p.cy <= p.h[p.page]))
    end = np.where(doc >= 0, p.y[doc] - 10, p.h * 0.85)[p.page]
    head = p.most(p.cy, p.tags(), np.nan)
    head = np.where(np.isnan(head), p.h * 0.05, head)[p.page]
    place = p.cx / p.w[p.page]
    is_code = p.matches(ITEM_CODE) & (lo[p.page] <= place) & (place < hi[p.page] + 0.03)
    start = -p.most(25 - p.cy, is_code & (p.cy > head + 30) & (p.cy < end), -np.inf)[p.page]
    at = np.flatnonzero((p.cy >= start) & (p.cy <= end))
    return at[np.lexsort((at, p.cy[at], p.page[at]))], is_code


def split_rows(p: Pages, at: np.ndarray, is_code: np.ndarray, gap: int = ROW_GAP) -> tuple[np.ndarray, np.ndarray]:
    """For words in order of height: the number of the text row, a new one at each
    gap, and of its part; a row with several codes is cut half-way between them."""
    row = np.cumsum(np.r_[True, (np.diff(p.page[at]) != 0) | (np.diff(p.cy[at]) >= gap)][: len(at)])
    part, codes = np.zeros(len(at), int), np.bincount(row[is_code[at]], minlength=int(row[-1]) + 1 if len(row) else 1)
    for r in np.flatnonzero(codes > 1):
        own = slice(*np.searchsorted(row, (r, r + 1)))
        heights = p.cy[at[own]]
        middles = heights[is_code[at[own]]]
        part[own] = np.searchsorted((middles[:-1] + middles[1:]) / 2, heights, side="right")
    return row, part


def read_items(p: Pages, columns: list | None = None) -> list[list[dict]]:
    """The text rows of each page, before the footer, that may hold a code: what
    stands in each column, and the box."""
    columns = layouts(p) if columns is None else columns
    at, is_code = region(p, columns)
    row, part = split_rows(p, at, is_code)
    place, col = p.cx[at] / p.w[p.page[at]], np.full(len(at), -1)
    for k in range(max(map(len, columns), default=0)):
        lo, hi = (np.array([c[k][e] if k < len(c) else np.nan for c in columns])[p.page[at]] for e in (1, 2))
        col = np.where((col < 0) & (lo <= place) & (place < hi), k, col)
    order = np.lexsort((at, p.cy[at], p.cx[at], part, row))
    at, row, part, col = at[order], row[order], part[order], col[order]
    cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(part) != 0)) + 1
    starts, ends = np.r_[0, cuts].tolist(), np.r_[cuts, len(at)].tolist()
    pages, texts, known = p.page[at].tolist(), p.text.take(pa.array(at)).to_pylist(), p.known[at].tolist()
    conf, x, y, x2, y2, cx, cy = (v[at].tolist() for v in (p.conf, p.x, p.y, p.x2, p.y2, p.cx, p.cy))
    row, part, col = row.tolist(), part.tolist(), col.tolist()
    out, ended = [[] for _ in range(p.n)], -1
    for start, end in zip(starts, ends, strict=True) if len(at) else ():
        page = pages[start]
        if page == ended:
            continue
        names = [c for c, _, _ in columns[page]]
        cells = [[] for _ in names]
        for i in range(start, end):
            if col[i] >= 0 and known[i]:
                cells[col[i]].append(i)
        joined = [" ".join([texts[i] for i in cell]) for cell in cells]
        whole = " ".join(joined).upper()
        if "NOMBRE DEL PRODUCTO" in whole or ("PRESEN" in whole and "CANTIDAD" in whole):
            continue
        if "ULTIMA" in whole or "LINEA" in whole:
            ended = page
            continue
        text, cell = dict(zip(names, joined, strict=True)), dict(zip(names, cells, strict=True))
        raw = text.get("codigo", "")
        if not RUNS.search(raw):
            continue
        numbers = {}
        for c in QUANTITIES:
            middle = next(((lo + hi) / 2 * float(p.w[page]) for k, lo, hi in columns[page] if k == c), None)
            numbers[c] = pick_number([(texts[i], conf[i], x[i], y[i], x2[i], y2[i], cx[i]) for i in cell.get(c, ())], middle)
        marks = [{"digits": REST.sub("", texts[i]), "cy": cy[i], "y": y[i], "y2": y2[i]} for i in cell["codigo"] if CODE.search(texts[i])]
        box = {"row": row[start], "part": part[start], "y1": min(y[start:end]), "y2": max(y2[start:end])}
        out[page].append(box | {c: text.get(c, "") for c in ("idem", "nombre_producto", "presentacion")} | numbers | {"marks": marks, "raw": raw})
    return out


def may_be_receipt(p: Pages) -> np.ndarray:
    return (p.first(p.holds("ACTA")) >= 0) & (p.first(p.holds("RECIBIDO")) >= 0)


def extract_header(tokens: DataFrame) -> DataFrame:
    """file_id and eight header fields, from the top of each page."""
    return on_pages(tokens, header, schema_of(HEADER_FIELDS))


def extract_signatures(tokens: DataFrame) -> DataFrame:
    return on_pages(tokens, signatures, schema_of(SIGNATURE_FIELDS))


def document_number(tokens: DataFrame) -> DataFrame:
    """file_id, no_doc: digits on the right of ``DOC.``, else of ``SAFIS``."""
    return on_pages(tokens, lambda p: {"no_doc": number(p)}, "no_doc string")


def detect_columns(tokens: DataFrame) -> DataFrame:
    """file_id, layout: column bounds inferred from the heading of the items."""
    named = lambda page: [{"col": c, "lo": lo, "hi": hi} for c, lo, hi in page]
    return on_pages(tokens, lambda p: {"layout": [named(page) for page in layouts(p)]}, f"layout {LAYOUT_TYPE}")


def coded_items(rows: DataFrame, master: DataFrame) -> DataFrame:
    """One row for each code of a page (the last reading of it)."""
    coded = clean_codes(rows, [c for c in rows.columns if c != "raw"], "raw", master).where("codigo is not null")
    # a row that runs over several lines is cut to the height around its code
    real = F.get(F.filter("marks", lambda m: m["digits"] == F.col("codigo")), F.lit(0))
    half = F.greatest(F.lit(20), F.floor((real["y2"] - real["y"]) * 0.9))
    tall = (F.col("y2") - F.col("y1") > 80) & real.isNotNull()
    items = coded.select(
        PAGE, "row", "part", "idem", "nombre_producto", "presentacion", "codigo", *QUANTITIES,
        F.when(tall, (real["cy"] - half).cast("int")).otherwise(F.col("y1").cast("int")).alias("box_y1"), F.when(tall, (real["cy"] + half).cast("int")).otherwise(F.col("y2").cast("int")).alias("box_y2"), "verified",
    )
    return first_of(items, [PAGE, "codigo"], F.desc("row"), F.desc("part")).drop("row", "part")


def warehouse_receipt(tokens: DataFrame, master: DataFrame, master_is_empty: bool = False) -> DataFrame:
    """The single line of a goods receipt, for pages that are one."""
    extent = page_extent(tokens)
    sized = tokens.join(extent, PAGE)
    act = tokens.where(F.contains(F.upper("text"), F.lit("ACTA"))).select(PAGE).distinct()
    received = sized.where(F.contains(F.upper("text"), F.lit("RECIBIDO")) & (F.col("cy") < F.col("page_h") * 0.60)).groupBy(PAGE).agg(F.min_by(F.struct("cx", "y2"), F.struct("cy", "tok_seq")).alias("a"))
    nine = tokens.withColumn("codigo", digits(F.col("text"))).where(F.length("codigo") == 9)
    known = master.select("codigo", F.lit(True).alias("verified"))
    coded = nine.join(known, "codigo", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    if not master_is_empty:
        coded = coded.where("verified")
    # the code that stands there most often, and where it stands first
    counted = coded.groupBy(PAGE, "codigo", "verified").agg(F.count(F.lit(1)).alias("n"), F.min("tok_seq").alias("seq"), F.min_by(F.struct("cy", "x2"), F.struct("cy", "tok_seq")).alias("c"))
    chosen = counted.groupBy(PAGE).agg(F.max_by(F.struct("codigo", "verified", "c"), F.struct(F.col("n"), -F.col("seq"))).alias("k"))
    page = extent.join(act, PAGE, "left_semi").join(received, PAGE).join(chosen, PAGE)
    met = tokens.join(page, PAGE)
    plain = F.regexp_replace(F.trim("text"), ",", ".")
    dy, dx = F.col("y") - F.col("a.y2"), F.abs(F.col("cx") - F.col("a.cx"))
    is_amount = plain.rlike(r"^[0-9]+(\.[0-9]+)?$") & dy.between(0, F.col("page_h") * 0.12) & (dx <= F.col("page_w") * 0.12)
    amount = F.min_by(F.struct(F.col("text"), F.col("y"), F.col("y2")), F.when(is_amount, F.struct(dy + dx * 0.20, F.col("tok_seq"))))
    is_word = (F.abs(F.col("cy") - F.col("k.c.cy")) <= 35) & (F.col("x") > F.col("k.c.x2")) & (F.col("x") < F.col("page_w") * 0.72) & ~F.col("text").rlike(r"^[|_\-]+$")
    words = F.sort_array(F.collect_list(F.when(is_word, F.struct("x", "tok_seq", "text"))))
    found = met.groupBy(PAGE, "k").agg(amount.alias("q"), F.array_join(F.transform(words, lambda t: t["text"]), " ").alias("nombre_producto")).where("q is not null")
    quantity = receipt_quantity(F.col("q.text"))
    return found.select(PAGE, F.lit("").alias("idem"), "nombre_producto", F.lit("").alias("presentacion"), F.col("k.codigo").alias("codigo"), quantity.alias("cant_solicitada"), quantity.alias("cant_despachada"), F.col("q.y").cast("int").alias("box_y1"), F.col("q.y2").cast("int").alias("box_y2"), F.col("k.verified").alias("verified"))


def found_items(read: DataFrame, master: DataFrame) -> DataFrame:
    """Items of pages that were read (file_id, rows, receipt) and written."""
    acts = read.where("receipt is not null").select(PAGE, F.inline("receipt"))
    receipts = keep(warehouse_receipt(acts, master), "receipts")
    rows = read.select(PAGE, F.inline("rows"))
    if not receipts.isEmpty():
        rows = rows.join(receipts.select(PAGE).distinct(), PAGE, "left_anti")
    return coded_items(rows, master).unionByName(receipts)


def page_items(tokens: DataFrame, master: DataFrame) -> DataFrame:
    """Items of every page; a page that is a goods receipt is read as one."""
    return found_items(keep(on_pages(tokens, lambda p: {"rows": read_items(p)}, ROWS, may_be_receipt), "rows"), master)
