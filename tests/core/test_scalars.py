"""Worked examples of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from requisita.functions import scalars as s


def each(spark, function, rows, *columns):
    """Results of a Column function over rows of text, in order."""
    names = columns or ("a",)
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(function(*(F.col(n) for n in names)).alias("v"), "i").orderBy("i").collect()]


def test_to_number(spark):
    rows = ["100", "100.00", "1,234", "| 45", "", "abc", None, "1d", "nan", " 7 ", "-3", ".5", "1_000"]
    assert each(spark, s.to_number, rows) == [100, 100, 1234, 45, None, None, None, None, None, 7, -3, 0.5, None]


def test_clean_id(spark):
    assert each(spark, s.clean_id, [None, " a ", "12.0", "\t4931159608\n"]) == ["", "a", "12.0", "4931159608"]
    df = spark.createDataFrame([(4931159608.0,), (1.5,), (None,)], "a double").coalesce(1)
    assert [r[0] for r in df.select(s.clean_id(F.col("a"), "double")).collect()] == ["4931159608", "1.5", ""]


def test_one_edit_apart(spark):
    rows = [("910100357", "910100367"), ("91010035", "910100357"), ("1", "1"), ("902000857", "910200085")]
    assert each(spark, s.one_edit_apart, rows, "a", "b") == [True, True, False, False]


def test_normal_text(spark):
    assert each(spark, s.normal_text, ["Papel  bond, año", None, "Ácido-2%"]) == ["PAPEL BOND ANO", "", "ACIDO 2"]


def test_dates(spark):
    rows = ["4931159608_05.03.2026.pdf", "x_05-03-26.pdf", "x_05.0326.pdf", "_31.02.2026.pdf", "x-2025.pdf", "x.pdf", None]
    day = datetime.date(2026, 3, 5)
    assert each(spark, s.date_from_filename, rows) == [day, day, day, None, None, None, None]
    got = each(spark, s.date_range_from_filename, rows)
    assert got[0].label == "05.03.2026" and got[3].label == "año 2026" and got[4].start == datetime.date(2025, 1, 1) and got[4].end == datetime.date(2025, 12, 31) and got[5] is None


def test_quantities(spark):
    assert each(spark, s.pick_best_quantity, [("230", "2300"), ("5", "7"), ("", "7"), ("x", "7"), ("x", "")], "a", "b") == ["230", "5", "7", "7", "x"]
    assert each(spark, s.needs_refinement, [("", "5"), ("2300", "5"), ("5", ""), ("5", "5"), ("42", "12")], "a", "b") == [True, True, True, False, True]
    rows = [("42", "12", ""), ("42", "12", "42"), ("42", "12", "50"), ("", "12", "5"), ("120", "12", "50")]
    assert each(spark, s.accept_local_cell, rows, "a", "b", "c") == ["12", "42", "42", "12", "12"]
    assert each(spark, s.receipt_quantity, ["1,500", "12.0", "12.5"]) == ["1500", "12", "12.5"]


def test_position_tag(spark):
    assert each(spark, s.is_position_tag, ["(12)", "[3-4]", "12"]) == [True, True, False]


#: file name, local reading, model, document, source
NUMBERS = [
    ("4931159608", "4931159608", "4931159608", "4931159608", "gemini + OCR local"),
    ("4931159608", "4930000000", "4930000000", "4931159608", "nombre archivo (descarta lectura sospechosa)"),
    ("159608", "4931159608", None, "4931159608", "OCR local (número completo)"),
    ("159608", "4931159608", "159608", "4931159608", "OCR local (número completo, Gemini abreviado)"),
    ("159608", None, "4931159608", "4931159608", "gemini (número completo)"),
    ("159608", "4931159603", "4931159608", "4931159608", "gemini (número completo, OCR local incoherente)"),
    ("4931159608", "4931159000", "4931159608", "4931159608", "gemini + nombre archivo"),
    ("4931159608", "4931159608", "4931159600", "4931159608", "OCR local + nombre archivo"),
    ("4931159608", "4931150000", "4931151111", "4931159608", "nombre archivo (Gemini sin consenso)"),
    (None, "4931150000", "4931151111", "4931151111", "gemini"),
    ("4931159608", None, None, "4931159608", "nombre_archivo"),
    (None, None, None, None, "nombre_archivo"),
    ("4931159608", "4931159603", None, "4931159608", "nombre archivo (corrige OCR)"),
    ("4930843220", "4930842933", None, "4930842933", "OCR local"),
    (None, "4931159608", None, "4931159608", "OCR local"),
]


def test_resolve_doc_number(spark):
    got = each(spark, s.resolve_doc_number, [n[:3] for n in NUMBERS], "a", "b", "c")
    assert [(g.no_doc, g.source) for g in got] == [n[3:] for n in NUMBERS]


@pytest.mark.parametrize("text,alike", [(("902000857", "910200085"), 0.8889), (("", "x"), 0.0)])
def test_code_similarity(spark, text, alike):
    from requisita.operators.repair import seq_ratio

    assert spark.createDataFrame([text], "a string, b string").select(seq_ratio("a", "b")).first()[0] == pytest.approx(alike, abs=1e-4)
