"""The comparison from end to end, and its parts, on small cases."""

import datetime
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from requisita.operators import reconcile, report
from requisita.operators.dedup import best_copy, physical_dedup
from requisita.operators.repair import choose_codes, choose_targets, repair_codes
from requisita.plans.registry import QUERIES
from requisita.sources.scratch import drop, keep, shared_folder

A, B, C, D, E = "4930000100", "4930000200", "4930000300", "4930686990", "4930000999"
LEDGER = [(A, "910000001", -10), (A, "910000002", -5), (A, "910000002", -3), (A, "910000003", 0), (A, "910000004", -2), (A, "910000005", -12), (B, "910000011", -4), (C, "910000012", -9), (D, "910000021", -1), (D, "910000022", -2), (D, "910000023", -3)]
SCAN = [
    ("a1.pdf", "h1", A, "910000001", "10"), ("a1.pdf", "h1", A, "910000002", "8"), ("a1.pdf", "h1", A, "910000003", "0"), ("a1.pdf", "h1", A, "910000009", "7"), ("a1.pdf", "h1", A, "910000015", "12"),
    ("a1_copy.pdf", "h2", A, "910000001", "10"), ("b.pdf", "h3", B, "910000011", ""),
    ("d.pdf", "h4", "4930686996", "910000021", "1"), ("d.pdf", "h4", "4930686996", "910000022", "2"), ("d.pdf", "h4", "4930686996", "910000023", "3"),
    ("4930000999_15.03.2020.pdf", "h5", E, "910000031", "6"),
]


@pytest.fixture(scope="module")
def ledger(spark):
    days = [datetime.date(2026, 1, 10), datetime.date(2026, 2, 20)]
    rows = [(i, d, c, str(q), "paper", days[i % 2]) for i, (d, c, q) in enumerate(LEDGER)]
    return spark.createDataFrame(rows, "row_seq long, no_doc string, codigo string, cant_despachada string, nombre_producto string, fecha date")


@pytest.fixture(scope="module")
def scan(spark):
    rows = [(i, *r, "paper") for i, r in enumerate(SCAN)]
    return spark.createDataFrame(rows, "row_seq long, archivo string, archivo_hash string, no_doc string, codigo string, cant_despachada string, nombre_producto string").repartition(3)


@pytest.fixture(scope="module")
def merged(ledger, scan):
    return reconcile.compare(ledger, scan).cache()


@pytest.mark.parametrize("fuzzy", [False, True])
def test_states(ledger, scan, fuzzy):
    got = {(r.no_doc, r.codigo): (r.cant_despachada_ext, r.cant_despachada_esc, r.estado) for r in reconcile.compare(ledger, scan, fuzzy).collect()}
    assert got == {
        (A, "910000001"): (10, 10, "ok"), (A, "910000002"): (8, 8, "ok"), (A, "910000004"): (2, None, "solo_externa"), (A, "910000005"): (12, 12, "ok"), (A, "910000009"): (None, 7, "solo_escaneada"),
        (B, "910000011"): (4, 0, "cant_despachada_difiere"), (D, "910000021"): (1, 1, "ok"), (D, "910000022"): (2, 2, "ok"), (D, "910000023"): (3, 3, "ok"), (E, "910000031"): (None, 6, "solo_escaneada"),
    }


def test_summary_and_figures(merged, scan, ledger):
    summary = report.document_summary(merged)
    got = {r.no_doc: tuple(r)[1:] for r in summary.collect()}
    assert got == {A: (5, 3, 2, "faltan escaneadas, faltan en SAFISS"), B: (1, 0, 1, "cantidad ≠"), D: (3, 3, 0, "OK"), E: (1, 0, 1, "faltan en SAFISS")}
    outside = report.out_of_range(summary, merged, scan, ledger)
    assert [tuple(r) for r in outside.collect()] == [(E, "15.03.2020")]
    nobody = scan.limit(0).select("no_doc")
    tagged = report.tag_summary(summary, outside, nobody)
    row = report.key_figures(tagged, nobody, scan).first()
    assert (row.docs, row.docs_ok, row.docs_out, row.docs_bad, row.extra_copies, row.files) == (4, 1, 1, 2, 1, 5)
    assert report.tag_detail(merged, outside).where("estado = 'fuera_rango'").count() == 1


def test_empty_scan_keeps_the_ledger(ledger, scan):
    got = reconcile.compare(ledger, scan.limit(0))
    assert {r.estado for r in got.collect()} == {"solo_externa"} and got.count() == 9


def test_empty_ledger(ledger, scan):
    assert {r.estado for r in reconcile.compare(ledger.limit(0), scan).collect()} == {"solo_escaneada"}


def test_missing_key(ledger):
    with pytest.raises(ValueError):
        reconcile.with_keys(ledger.drop("codigo"))


def test_copies(scan):
    seen = reconcile.with_keys(scan)
    assert {r.archivo for r in best_copy(physical_dedup(seen)).where(f"no_doc = '{A}'").collect()} == {"a1.pdf"}


def test_targets_are_exclusive(spark):
    # a takes x, so b is left with y alone; c contends with b for y and comes too late
    rows = [("a", "x", 1.0), ("b", "x", 1.0), ("b", "y", 0.95), ("c", "y", 0.9), ("d", "z", 0.8), ("d", "w", 0.75)]
    found = spark.createDataFrame([(*r, 0.0, False) for r in rows], "scanned string, target string, score double, own double, known boolean")
    assert {(r.scanned, r.target) for r in choose_targets(found).collect()} == {("a", "x"), ("b", "y")}


def test_target_must_beat_a_known_document(spark):
    rows = [("a", "x", 0.7, 0.45, True), ("b", "y", 0.75, 0.45, True)]
    found = spark.createDataFrame(rows, "scanned string, target string, score double, own double, known boolean")
    assert {r.scanned for r in choose_targets(found).collect()} == {"b"}


def test_codes_need_a_clear_lead(spark):
    rows = [(1, "p", 0.9, True), (1, "q", 0.99, False), (2, "p", 0.9, True), (2, "q", 0.5, True), (3, "p", 0.8, False), (3, "q", 0.7, False), (4, "p", 0.9, False), (4, "q", 0.7, False)]
    found = spark.createDataFrame(rows, "row_seq long, new_code string, score double, strong boolean")
    assert {r.row_seq for r in choose_codes(found).collect()} == {1, 4}


def test_second_reading_of_a_line_goes(spark):
    ledger = spark.createDataFrame([("d", "910000001", 5.0, "x")], "no_doc string, codigo string, q double, nombre_producto string")
    scan = lambda rows: spark.createDataFrame([(i, "d", c, q, "x") for i, (c, q) in enumerate(rows)], "row_seq long, no_doc string, codigo string, q double, nombre_producto string")
    assert [r.codigo for r in repair_codes(ledger, scan([("910000002", 5.0), ("910000003", 5.0)])).collect()] == ["910000001"]
    assert sorted(r.codigo for r in repair_codes(ledger, scan([("910000002", 5.0), ("910000001", 5.0)])).collect()) == ["910000001"]
    assert [r.codigo for r in repair_codes(ledger, scan([("910000002", 6.0)])).collect()] == ["910000002"]


def test_export_names(spark):
    raw = spark.createDataFrame([(" 1 ", "2", -3.0, "x")], "`Documento material` string, Material string, `Ctd.en UM entrada` double, Centro string")
    row = reconcile.normalize_ledger(raw).first()
    assert (row.no_doc, row.codigo, row.cant_despachada, row.Centro) == ("1", "2", 3.0, "x")


def test_order_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "zz int, codigo int, archivo int")
    assert report.order_columns(df).columns == ["archivo", "codigo", "zz"]


def plain_repair(ledger, scan):
    """Codes corrected row by row; rows are (no_doc, codigo, q, name), and those of
    the scan have their place before."""
    from difflib import SequenceMatcher

    def words(t):
        return " ".join("".join(c if c.isalnum() else " " for c in t.upper()).split())

    def one_edit(a, b):
        return a != b and (any(a[:i] + b[i : i + 1] + a[i + 1 :] == b for i in range(len(a))) or any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))))

    def alike(a, b):
        return SequenceMatcher(None, a, b).ratio()

    def product(a, b):
        a, b = words(a), words(b)
        if not a or not b:
            return 0.0
        x, y = set(a.split()), set(b.split())
        return max(alike(a, b), len(x & y) / max(1, min(len(x), len(y))))

    listed, chosen = {(d, c) for d, c, _, _ in ledger}, {}
    for seq, doc, code, q, name in scan:
        if q <= 0 or (doc, code) in listed:
            continue
        found = []
        for d, c, n, other in ledger:
            if d == doc and abs(n - q) <= 1e-6:
                score = 0.70 * product(name, other) + 0.30 * alike(code, c)
                strong = one_edit(code, c) or alike(code, c) >= 0.84
                if strong or (product(name, other) >= 0.55 and score >= 0.60):
                    found.append((not strong, -score, c))
        found.sort()
        if found and (len(found) == 1 or (found[1][0] if not found[0][0] else found[1][1] - found[0][1] >= 0.12)):
            chosen[seq] = found[0][2]
    out, taken = [], set()
    for seq, doc, code, q, _ in scan:
        new = chosen.get(seq)
        if new is not None:
            if any(d == doc and c == new and abs(n - q) <= 1e-6 for _, d, c, n, _ in scan) or (doc, new, q) in taken:
                continue
            taken.add((doc, new, q))
        out.append((seq, doc, new or code))
    return out


def test_fuzzy_repair_by_brute_force(spark):
    import random

    r = random.Random(5)
    names = ["PAPEL BOND CARTA", "papel bond oficio", "Tinta negra", "", "GUANTES LATEX M", "guantes de látex"]
    ledger, scan = [], []
    for doc in range(40):
        for _ in range(4):
            code, q, name = str(910000000 + r.randrange(10**6)), float(r.randrange(1, 4)), r.choice(names)
            ledger.append((f"d{doc}", code, q, name))
            digits = list(code)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                digits[r.randrange(9)] = str(r.randrange(10))
            scan.append((len(scan), f"d{doc}", "".join(digits), q, name.upper() if r.random() < 0.7 else r.choice(names)))
            if r.random() < 0.2:  # a second reading of the line
                scan.append((len(scan), f"d{doc}", code, q, name))
    left = spark.createDataFrame(ledger, "no_doc string, codigo string, q double, nombre_producto string")
    right = spark.createDataFrame(scan, "row_seq long, no_doc string, codigo string, q double, nombre_producto string")
    found = {(x.row_seq, x.no_doc, x.codigo) for x in repair_codes(left, right, fuzzy=True).collect()}
    want = set(plain_repair(ledger, scan))
    assert found == want and len(want - {(s, d, c) for s, d, c, _, _ in scan}) > 20
    assert found != {(x.row_seq, x.no_doc, x.codigo) for x in repair_codes(left, right).collect()}


def test_shuffles_go_with_the_table_they_made(spark):
    blocks = lambda: sum(str(b).startswith("shuffle_") for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()))
    before = blocks()
    kept = keep(spark.range(1000).repartition(7, "id"), "dealt")
    deadline = time.time() + 10
    while blocks() > before and time.time() < deadline:
        time.sleep(0.2)
    assert blocks() <= before
    assert kept.count() == 1000
    drop(kept)
    assert not glob.glob(f"{shared_folder(spark)}/dealt-*")


def test_order_lines_are_read_once(spark):
    for name in ("kpi_totals", "overlap_score"):
        assert "lineitem" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_only_tables_that_are_read_stay(spark, ledger, scan):
    before = set(glob.glob(f"{shared_folder(spark)}/*"))
    reconcile.compare(ledger, scan, fuzzy=False)
    names = " ".join(set(glob.glob(f"{shared_folder(spark)}/*")) - before)
    assert "/numbered-" in names and not [n for n in ("physical", "copies", "codes", "counts") if f"/{n}-" in names]


def test_written_tables_have_the_size_of_their_rows(spark):
    """Files of rows that compress well are small; their rows are not, and a
    broadcast of them doesn't fit a driver."""
    count, big = 400_000, spark.range(400_000).select(F.concat(F.lit("49300"), "id").alias("no_doc"), F.lit("of one value").alias("text"), F.lit(1).alias("n"))
    kept = keep(big, "compressed")
    limit = int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b"))
    assert sum(os.path.getsize(f) for f in glob.glob(f"{kept._requisita_path}/*.parquet")) < limit < count * 40
    assert "Broadcast" not in spark.range(10).select(F.col("id").cast("string").alias("no_doc")).join(kept, "no_doc", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in kept.join(keep(big.limit(5), "small").select("no_doc"), "no_doc", "left")._jdf.queryExecution().executedPlan().toString()
    assert kept.sparkSession is spark and spark.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"
    assert kept.where("n = 1").count() == count and keep(spark.range(0), "none").count() == 0
    drop(kept)
