"""From words to scan rows, with readings of strips, cells and an outside model."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from requisita.functions.scalars import ITEM_CODE
from requisita.operators import documents, extraction, forms, tokens
from requisita.operators.pages import WORD, on_pages
from requisita.plans import token_queries
from requisita.sources import adapters
from requisita.sources.scratch import keep, shared_folder


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([(f"91000000{i}",) for i in range(10)], "codigo string")


def items(spark, rows):
    """archivo, dpi, codigo, asked, sent, y, verified"""
    return spark.createDataFrame(
        [(a, d, c, "1", "name " + c, "UN", q, s, y, y + 20, v) for a, d, c, q, s, y, v in rows],
        "archivo string, dpi int, codigo string, idem string, nombre_producto string, presentacion string, cant_solicitada string, cant_despachada string, box_y1 int, box_y2 int, verified boolean",
    )


def test_commonest_number(spark):
    strips = spark.createDataFrame([("a", 300, "4930000001 x 4930000002\n4930000002 493000000299"), ("b", 300, "4930000009 4930000003"), ("c", 300, "12")], "archivo string, dpi int, text string")
    assert {tuple(r) for r in documents.commonest_number(strips).collect()} == {("a", 300, "4930000002"), ("b", 300, "4930000003")}


def rekey(rows, replies, valid):
    """The rule, row by row."""
    done = {}
    for code, verified in rows:
        new = replies.get(code, "")
        ok = len(new) == 9 and (not valid or new in valid)
        key = new if not verified and ok and new != code and new not in done else code
        done[key] = (code, verified or key != code)
    return done


def test_rekeyed_items(spark, master):
    rows = [("100000001", False), ("910000002", True), ("100000003", False), ("100000004", False), ("910000005", True), ("100000006", False)]
    replies = {"100000001": "910000001", "100000003": "910000002", "100000004": "910000005", "910000005": "910000009", "100000006": "999999999"}
    page = items(spark, [("f", 300, c, "1", "1", 10 * i, v) for i, (c, v) in enumerate(rows)])
    told = spark.createDataFrame([("f", 300, c, f" {t[:4]} {t[4:]}.") for c, t in replies.items()], "archivo string, dpi int, codigo string, text string")
    valid = {r.codigo for r in master.collect()}
    for known, names in ((master, valid), (master.limit(0), set())):
        found = documents.rekey_items(page, told, known).collect()
        want = rekey(rows, replies, names)
        assert {r.codigo: (r.nombre_producto[5:], r.verified) for r in found} == want


def test_pages_are_merged(spark):
    page = items(spark, [("f", 300, "a", "5", "", 10, True), ("f", 400, "a", "5", "52", 14, True), ("f", 400, "b", "", "2300", 40, True), ("f", 300, "c", "7", "123", 70, True), ("f", 400, "c", "7", "12", 72, True)])
    found = {r.codigo: (r.dpi, r.box_y1, r.cant_despachada) for r in documents.merge_pages(page).collect()}
    assert found == {"a": (300, 10, "52"), "b": (400, 40, "2300"), "c": (300, 70, "12")}


def test_cells_are_read_again(spark):
    rows = documents.merge_pages(items(spark, [("f", 300, c, q, s, 10, True) for c, q, s in (("a", "5", "5"), ("b", "5", ""), ("c", "", "42"), ("d", "9", "1234"))]))
    assert {r.codigo for r in documents.cells_to_read(rows).collect()} == {"b", "c", "d"}
    cells = spark.createDataFrame([("f", c, t) for c, t in (("a", "9"), ("b", "5"), ("c", "12"), ("d", "9"))], "archivo string, codigo string, text string")
    assert {r.codigo: r.cant_despachada for r in documents.with_local_cells(rows, cells).collect()} == {"a": "5", "b": "5", "c": "12", "d": "9"}


def test_model_numbers(spark):
    schema = "archivo string, no_doc string, no_doc_ocr_local string, no_doc_archivo string, no_doc_fuente string, no_doc_coincide_archivo boolean"
    headers = spark.createDataFrame([("a", "4930000001", "4930000001", None, "OCR local", None), ("b", "4930000002", "4930000002", "4930000002", "OCR local + nombre archivo", True), ("c", "4930000003", None, "4930000003", "nombre_archivo", None), ("d", "x", None, None, "y", None)], schema)
    told = spark.createDataFrame([("a", "No. 4930000001"), ("b", "4930000002"), ("c", "4930000003"), ("d", "12")], "archivo string, text string")
    found = {r.archivo: r for r in documents.with_model_number(headers, told).collect()}
    assert (found["a"].no_doc_fuente, found["a"].no_doc_coincide_archivo, found["a"].no_doc_coincide_ocr) == ("gemini + OCR local", None, True)
    assert found["b"].no_doc_coincide_archivo is True
    # with a model's number, the file's name alone is enough to compare
    assert (found["c"].no_doc_fuente, found["c"].no_doc_coincide_archivo, found["c"].no_doc_coincide_ocr) == ("gemini + nombre archivo", True, None)
    assert (found["d"].no_doc, found["d"].no_doc_fuente, found["d"].no_doc_gemini) == ("x", "y", None)


def test_table_replies(spark, master):
    page = items(spark, [("f", 300, f"91000000{i}", "1", "1", 10 * i, True) for i in range(4)])
    rows = documents.merge_pages(page)
    line = lambda i, q: f'{{"codigo": "91000000{i}", "cant_solicitada": "8", "cant_despachada": "{q}"}}'
    replies = spark.createDataFrame([("f", 0, "[" + ",".join([line(0, 5), line(1, 6), line(7, 4)]) + "]"), ("f", 1, "[" + line(0, 5) + "]")], "archivo string, reply int, text string")
    cells = spark.createDataFrame([("f", "910000002", "read 3"), ("f", "910000003", "VACIO"), ("f", "910000000", "9")], "archivo string, codigo string, text string")
    found = documents.with_table_replies(rows, page, replies, master, cells)
    assert {r.codigo: (r.cant_solicitada, r.cant_despachada) for r in found.collect()} == {"910000000": ("8", "5"), "910000001": ("8", "6"), "910000007": ("8", "4"), "910000002": ("1", "3"), "910000003": ("1", "1")}


def test_exact_digits(spark):
    texts = spark.createDataFrame([("No. 49-3000 0001",), ("12",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(extraction.exact_digits(F.col("t"), 10)).collect()] == ["4930000001", None, None, None]


def test_a_folder_is_extracted(spark, tmp_path, master):
    """Files of plain words stand for images: word,x,y,width."""
    head = "DOC.,100,1300,50 4930000001,200,1300,100 MOV,50,100,40 201,50,140,40 .,980,1480,20"
    table = "CODIGO,130,300,60 NOMBRE,300,300,60 PRODUCTO,400,300,100 PRESENTACION,580,300,120 SOLICITADA,740,300,60 DESPACHADA,860,300,60"
    line = "1,40,360,20 910000001,120,360,80 Papel,300,360,100 UN,600,360,40 5,750,360,16 4,870,360,16"
    (tmp_path / "4930000001_a.pdf").write_text(" ".join((head, table, line)))
    (tmp_path / "b.png").write_text(head)
    (tmp_path / "c.pdf").write_text(" ")
    (tmp_path / "d.pdf").write_text("bad")
    (tmp_path / "done.pdf").write_text(head)

    def recognise(content, dpi):
        out = []
        for word in content.decode().split():
            text, x, y, w = word.split(",")
            out.append({"text": text, "conf": 90, "x": int(x), "y": int(y), "x2": int(x) + int(w), "y2": int(y) + 20})
        return out

    done = spark.createDataFrame([("done.pdf",)], "archivo string")
    rows = {r.archivo: r for r in documents.extract_folder(spark, str(tmp_path), recognise, master, done).collect()}
    assert set(rows) == {"4930000001_a.pdf", "b.png", "c.pdf", "d.pdf"}
    a = rows["4930000001_a.pdf"]
    assert (a.no_doc, a.mov, a.codigo, a.cant_solicitada, a.cant_despachada, a.no_doc_fuente) == ("4930000001", "201", "910000001", "5", "4", "OCR local + nombre archivo")
    assert (rows["b.png"].no_doc, rows["b.png"].codigo, rows["b.png"].error) == ("4930000001", None, None)
    assert rows["c.pdf"].error == rows["d.pdf"].error == documents.NOTHING_READ


def test_words_are_written_once(spark):
    """Kept words are not copied; receipts among them are told apart."""
    sf = "/root/testdata/sf0.001"
    listed = token_queries.master(spark, sf)
    pages = adapters.form_tokens(spark, sf).where("file_id < 1000")
    receipt = adapters.receipt_tokens(spark, sf).where("file_id = 1").withColumn("file_id", F.col("file_id") + 10**9)
    words, before = keep(pages, "words"), set(glob.glob(f"{shared_folder(spark)}/*"))
    items = {tuple(r) for r in forms.page_items(words, listed).collect()}
    written = {p.rsplit("/", 1)[1].split("-")[0] for p in set(glob.glob(f"{shared_folder(spark)}/*")) - before}
    assert written == {"receipts", "rows"}
    both = {tuple(r) for r in forms.page_items(words.unionByName(receipt), listed).collect()}
    assert items and {r for r in both if r[0] < 10**9} == items
    assert [r[4] for r in both - items] == ["910000001"]


def test_pages_may_come_as_arrays(spark):
    """The same words and scan rows, whether a row is a word or a page."""
    sf = "/root/testdata/sf0.001"
    files = adapters.form_files(spark, sf).where("file_id < 40000")
    some = lambda df: df.join(files.select("archivo"), "archivo", "left_semi")
    words, pages = some(adapters.form_readings(spark, sf)), some(adapters.form_pages(spark, sf))
    columns = ["archivo", "dpi", *WORD]
    assert words.select(columns).exceptAll(pages.select("archivo", "dpi", F.inline("words")).select(columns)).isEmpty()
    listed, shuffled = token_queries.master(spark, sf), pages.withColumn("words", F.shuffle("words"))
    by_word, by_page = ([tuple(r) for r in documents.process_documents(files, t, listed).collect()] for t in (words, shuffled))
    assert by_word and sorted(by_word, key=str) == sorted(by_page, key=str)


def test_look_ups_within_pages(spark):
    """As the joins of ``tokens`` find them, on pages of words at random places."""
    r = random.Random(5)
    texts = ["DOC.", "doc. x", "Ana", ":b:", "-", "(1)", "[2-3]", "POR", "Firma", "ﬁrma", "123456", "7654321", "ß.", "x"]
    rows = [(f, i, r.choice(texts), 90, x := 10 * r.randrange(60), y := 10 * r.randrange(40), x + 40, y + 20, x + 20.0, y + 10.0) for f in range(80) for i in range(r.randrange(1, 40))]
    words = keep(spark.createDataFrame(rows, "file_id int, tok_seq int, text string, conf int, x int, y int, x2 int, y2 int, cx double, cy double"), "words")
    found = tokens.anchors(words, {"doc": ["DOC."]})

    def read(p):
        a = p.first(p.holds("DOC."))
        at = np.lexsort((p.seq, p.cy, p.page))
        row, part = forms.split_rows(p, at, p.matches(ITEM_CODE))
        first = np.r_[0, np.cumsum(np.bincount(p.page))][p.page[at]]
        cut = [[] for _ in range(p.n)]
        for i, place, k in zip(at, row - row[first], part, strict=True):
            cut[p.page[i]].append({"tok_seq": int(p.seq[i]), "row": int(place), "part": int(k)})
        return {"below": p.value_below(a, p.tags()), "right": p.value_right(a), "line_below": p.line_below(a), "line_right": p.line_right(a), "cut": cut}

    pages = on_pages(words, read, "below string, right string, line_below string, line_right string, cut array<struct<tok_seq int, row int, part int>>").collect()
    for name, f in (("below", tokens.value_below), ("right", tokens.value_right), ("line_below", tokens.line_below), ("line_right", tokens.line_right)):
        want = {r.file_id: r.value for r in f(words, found).collect() if r.value is not None}
        assert want and {p.file_id: p[name] for p in pages if p[name] is not None} == want, name
    cut = tokens.split_rows(tokens.group_rows(words), F.col("text").rlike(ITEM_CODE)).collect()
    assert {(p.file_id, *w) for p in pages for w in p.cut} == {(w.file_id, w.tok_seq, w.row, w.part) for w in cut}
    assert any(w.part for w in cut)
