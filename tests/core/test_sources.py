"""Files, archives, providers, streaming."""

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from requisita.operators.extraction import header_fallback, parse_replies
from requisita.plans.registry import QUERIES
from requisita.sources import files, providers
from requisita.streaming import incremental


def test_listing(spark):
    paths = spark.createDataFrame([("b.pdf",), ("a.PDF",), ("c.Pdf",), ("d.txt",), ("b.pdf",), ("e.tiff",)], "path string")
    assert [r.path for r in files.list_inputs(paths).collect()] == ["a.PDF", "b.pdf", "e.tiff"]
    assert [r.path for r in files.list_inputs(paths, 2).collect()] == ["a.PDF", "b.pdf"]


def test_archives(spark):
    def archive(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in members:
                z.writestr(name, content)
        return bytearray(out.getvalue())

    rows = [(archive([("x/a.pdf", b"1"), (".b.pdf", b"2"), ("c.txt", b"3"), ("y/a.pdf", b"4"), ("y/d.PNG", b"5")]), 0), (archive([("d.PNG", b"6"), ("e.pdf", b"7")]), 1), (bytearray(b"no archive"), 2)]
    members = files.unzip(spark.createDataFrame(rows, "content binary, arrival long"))
    loose = spark.createDataFrame([("a.pdf", bytearray(b"8"), 0), ("a.pdf", bytearray(b"9"), 1)], files.MEMBER)
    assert {(r.name, bytes(r.content)) for r in files.merge_uploads(members, loose).collect()} == {("a.pdf", b"9"), ("d.PNG", b"5"), ("e.pdf", b"7")}


def test_read_files_and_skip(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    (tmp_path / "c.png").write_bytes(b"z")
    found = files.read_files(spark, str(tmp_path))
    assert {r.archivo for r in found.collect()} == {"a.pdf", "c.png"}
    done = spark.createDataFrame([("a.pdf",)], "archivo string")
    assert [r.archivo for r in files.skip_done(found, done).collect()] == ["c.png"]


def test_ledger_csv_and_report(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('Documento material,Material,Ctd.en UM entrada,Fe.contabilización\n4930000100,910000001,-3,2026-01-02\n', encoding="utf-8")
    row = files.load_ledger(spark, str(path)).first()
    assert (row.no_doc, row.codigo, row.cant_despachada, str(row.fecha)) == ("4930000100", "910000001", 3.0, "2026-01-02")
    files.write_report({"a" * 40: spark.range(3), "b": spark.range(2)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / ("a" * 31))).count() == 3


def test_providers(spark):
    def recognise(content, dpi):
        if content == b"bad":
            raise ValueError("unreadable")
        return [] if content == b"blank" else [{"text": f"{content.decode()}{dpi}", "conf": 90, "x": 0, "y": 0, "x2": 10, "y2": 10}]

    some = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad")), ("c", bytearray(b"blank"))], "archivo string, content binary")
    got = providers.recognise_files(some, recognise).collect()
    assert {(r.archivo, r.dpi, r.text, r.error) for r in got} == {("a", 300, "ok300", None), ("a", 400, "ok400", None), *(("b", d, None, "unreadable") for d in (300, 400)), *(("c", d, None, "OCR sin resultados") for d in (300, 400))}

    def ask(prompt, image):
        if prompt == "x":
            raise TimeoutError
        return prompt.upper()

    replies = providers.ask_model(spark.createDataFrame([("a", None), ("x", None)], "prompt string, image binary"), ask)
    assert tuple(providers.call_counts(replies).first()) == (1, 1)


def test_pixels():
    page = np.full((60, 200, 3), 250, np.uint8)
    page[20:30, 50:60] = 0
    page[40, :, :] = 0
    page[5:15, 5:15] = (200, 30, 30)
    clean = providers.remove_colored_marks(page)
    assert clean[10, 10].tolist() == [255] * 3 and clean[25, 55].tolist() == [0] * 3
    binary = providers.remove_rules(providers.binarize(clean[:, :, 0]))
    assert binary[40].min() == 255 and binary[25, 55] == 0


def test_replies(spark):
    text = '[{"codigo":"910100357","cant_despachada":5},7,{"codigo":"12"}]'
    rows = spark.createDataFrame([(1, 0, text), (2, 0, "junk"), (3, 0, None), (4, 0, '[{"codigo":"910100358","cant_despachada":null}]')], "file_id long, reply int, text string")
    got = {(r.file_id, r.codigo, r.cant_solicitada, r.cant_despachada) for r in parse_replies(rows).collect()}
    assert got == {(1, "910100357", "", "5"), (4, "910100358", "", "None")}
    master = spark.createDataFrame([("910100357",)], "codigo string")
    assert parse_replies(rows, master).count() == 1


def test_header_fallback(spark):
    schema = "file_id long, no_doc string, source string, mov string"
    low = spark.createDataFrame([(1, None, "n", "201"), (2, "9", "l", "202")], schema)
    high = spark.createDataFrame([(1, "5", "h", "x"), (2, "6", "h", "y"), (3, "7", "h", "z")], schema)
    got = {tuple(r) for r in header_fallback(low, high, ["no_doc", "source"]).collect()}
    assert got == {(1, "5", "h", "201"), (2, "9", "l", "202"), (3, "7", "h", "z")}


def test_stream_equals_batch(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    schema = "archivo string, archivo_hash string, no_doc string, codigo string, cant_despachada string, row_seq long"
    rows = [(f"f{i % 6}.pdf", f"h{i % 6}", f"493000{i % 6}", f"91000000{i % 9}", str(i), i) for i in range(40)]
    scan = spark.createDataFrame(rows, schema)
    for i in range(3):
        scan.where(F.col("archivo").isin(f"f{2 * i}.pdf", f"f{2 * i + 1}.pdf")).coalesce(1).write.mode("append").parquet(str(source))
    seen = []
    stream = incremental.read_rows(spark, str(source), scan.schema)
    incremental.accumulate(stream, store, str(tmp_path / "check"), lambda every, n: seen.append(every.count())).awaitTermination()
    assert len(seen) == 3 and seen[-1] == 40
    ledger = scan.select("no_doc", "codigo", "cant_despachada", "row_seq").where("row_seq % 4 > 0")
    key = lambda df: {tuple(r) for r in df.collect()}
    assert key(incremental.live_summary(ledger, incremental.stored(spark, store))) == key(incremental.live_summary(ledger, scan))
    # nothing new: nothing is read again
    incremental.accumulate(incremental.read_rows(spark, str(source), scan.schema), store, str(tmp_path / "check")).awaitTermination()
    assert incremental.stored(spark, store).count() == 40


def test_words_of_a_long_text(spark, tmp_path):
    """(line * 100000 + pos) * 37 exceeds an int from line 581 on, the rest from line 21475 on."""
    spark.createDataFrame([(1, "\n".join(["a b"] * 22000))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.tok_seq: (r.text, r.conf) for r in QUERIES["confident_tokens"](spark, str(tmp_path)).collect()}
    every = {line * 100000 + pos: text for line in range(22000) for pos, text in enumerate("ab")}
    assert got == {seq: (text, seq * 37 % 101) for seq, text in every.items() if seq * 37 % 101 >= 30}
