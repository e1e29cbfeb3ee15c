"""Misread document numbers and codes, corrected from the ledger."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import TOLERANCE, clean_id, is_digits, normal_text, one_edit_apart, token_overlap
from ..sources.scratch import drop, keep
from .dedup import first_of

#: What an overlap must reach, and by how much it must lead.
OWN_IS_FINE, ENOUGH, BEATS_OWN, LEAD = 0.5, 0.7, 0.3, 0.1
STRONG_CODE, PRODUCT, SCORE, SCORE_LEAD = 0.84, 0.55, 0.60, 0.12
PRODUCT_WEIGHT, CODE_WEIGHT = 0.70, 0.30


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two texts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def code_sets(ledger: DataFrame, scan: DataFrame) -> DataFrame:
    """no_doc, codigo, listed, seen: which side has each distinct code of a
    document; of the scan, only what was dispatched."""
    side = lambda df, listed: df.select("no_doc", "codigo", F.lit(listed).alias("listed"), F.lit(not listed).alias("seen"))
    both = side(ledger, True).unionByName(side(scan.where("q > 0"), False))
    return both.groupBy("no_doc", "codigo").agg(F.bool_or("listed").alias("listed"), F.bool_or("seen").alias("seen"))


def code_counts(codes: DataFrame) -> DataFrame:
    """no_doc, n_listed, n_seen, n_both: one row for each document."""
    return codes.groupBy("no_doc").agg(F.count_if("listed").alias("n_listed"), F.count_if("seen").alias("n_seen"), F.count_if(F.col("listed") & F.col("seen")).alias("n_both"))


def _score(common: Column) -> Column:
    return common / F.greatest("n_seen", "n_listed")


def overlap_scores(codes: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """scanned, target, common, score: common codes over the larger set."""
    common = (
        pairs.join(codes.where("seen").select(F.col("no_doc").alias("scanned"), "codigo"), "scanned")
        .join(codes.where("listed").select(F.col("no_doc").alias("target"), "codigo"), ["target", "codigo"])
        .groupBy("scanned", "target")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    return (
        common.join(counts.select(F.col("no_doc").alias("scanned"), "n_seen"), "scanned")
        .join(counts.select(F.col("no_doc").alias("target"), "n_listed"), "target")
        .select("scanned", "target", "common", _score(F.col("common")).alias("score"))
    )


def number_pairs(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of numbers that differ in one place, or where one ends with the
    other, by one equi-join on masked numbers and on suffixes."""
    each = lambda c, kind, part: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.lit(kind), part(c, i)))
    masks = lambda c: each(c, "mask ", lambda c, i: F.overlay(c, F.lit("_"), i, F.lit(1)))
    ends = lambda c, kind: each(c, kind, lambda c, i: F.substring(c, i, F.length(c)))
    whole = lambda c, kind: F.array(F.concat(F.lit(kind), c))
    scanned, target = F.col("scanned"), F.col("target")
    left = docs.withColumn("key", F.explode(F.concat(masks(scanned), ends(scanned, "longer "), whole(scanned, "shorter "))))
    right = targets.withColumn("key", F.explode(F.concat(masks(target), whole(target, "longer "), ends(target, "shorter "))))
    return left.join(right, "key").where(scanned != target).select("scanned", "target").distinct()


def doc_candidates(ledger: DataFrame, scan: DataFrame) -> DataFrame:
    """scanned, target, score, own, known: ledger documents that a badly
    matching scanned document may be."""
    codes = keep(code_sets(ledger, scan), "codes")
    counts = keep(code_counts(codes), "counts")
    targets = counts.where("n_listed > 0").select(F.col("no_doc").alias("target"))
    seen = counts.where("n_seen > 0").select(F.col("no_doc").alias("scanned"), _score(F.col("n_both")).alias("own"), (F.col("n_listed") > 0).alias("known"))
    bad = seen.where(F.col("own") < OWN_IS_FINE)
    pairs = number_pairs(bad.select("scanned"), targets)
    for column in ("no_doc_ocr_local", "no_doc_gemini"):
        if column in scan.columns:
            read = scan.select(F.col("no_doc").alias("scanned"), clean_id(F.col(column)).alias("target")).where("target <> '' and target <> scanned").distinct()
            pairs = pairs.unionByName(read.join(targets, "target", "left_semi").join(bad, "scanned", "left_semi").select("scanned", "target"))
    scored = overlap_scores(codes, counts, keep(pairs.distinct(), "pairs")).where(F.col("score") >= ENOUGH)
    found = keep(scored.join(bad, "scanned").select("scanned", "target", "score", "own", "known"), "candidates")
    drop(codes, counts)
    return found


def choose_targets(candidates: DataFrame) -> DataFrame:
    """scanned, target: exclusive choice, scanned documents in ascending order.

    A document may be decided once no lesser undecided one wants any of its
    targets, so each round decides many; there are as many rounds as the longest
    chain of documents that contend.  Taken targets are out of all later
    comparisons, ambiguity included."""
    marked, rounds = keep(candidates, "candidates").withColumns({"waits": F.lit(True), "chosen": F.lit(False)}), []
    by_target, by_scanned = W.partitionBy("target"), W.partitionBy("scanned")
    # only eligible targets count, and those come first
    eligible = ~F.col("known") | (F.col("score") >= F.col("own") + BEATS_OWN)
    order = by_scanned.orderBy(F.desc("eligible"), F.desc("score"), "target")
    leads = F.col("next").isNull() | (F.col("score") - F.col("next") >= LEAD)
    while not rounds or not marked.where("waits").isEmpty():
        left = marked.where("waits").join(marked.where("chosen").select("target"), "target", "left_anti")
        # by target once for the join and the minimum, by document once for the rest
        wanted = left.withColumn("waits", F.min("scanned").over(by_target) < F.col("scanned"))
        ranked = wanted.withColumns({"waits": F.max("waits").over(by_scanned), "eligible": eligible})
        placed = ranked.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead(F.when(F.col("eligible"), F.col("score"))).over(order))
        decided = placed.withColumn("chosen", ~F.col("waits") & F.col("eligible") & (F.col("r") == 1) & leads)
        marked = keep(decided.select(*candidates.columns, "waits", "chosen"), f"round-{len(rounds)}")
        rounds.append(marked.where("chosen").select("scanned", "target"))
    return reduce(DataFrame.unionByName, rounds)


def renumber(ledger: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scan under corrected numbers, and which were corrected.  If any was,
    each code of a document keeps one row, of the document itself if it can."""
    remap = choose_targets(doc_candidates(ledger, scan))
    if remap.isEmpty():
        return scan.withColumn("no_doc_original", F.col("no_doc")), remap
    mapped = scan.join(remap.withColumnsRenamed({"scanned": "no_doc"}), "no_doc", "left").withColumn("no_doc_original", F.col("no_doc")).withColumn("no_doc", F.coalesce("target", "no_doc")).drop("target")
    return first_of(mapped, ["no_doc", "codigo"], F.col("no_doc") != F.col("no_doc_original"), "row_seq"), remap


def description_similarity(a: Column, b: Column) -> Column:
    x, y = normal_text(a), normal_text(b)
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(F.greatest(seq_ratio(x, y), token_overlap(x, y)))


def code_candidates(ledger: DataFrame, scan: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Ledger rows (not distinct codes) that an unknown scanned code may be:
    same document, same quantity, a similar code or, with ``fuzzy``, a similar
    description.  Cheap conditions are in the join, similarity above it."""
    codes = ledger.select("no_doc", "codigo").distinct()
    unknown = scan.where((F.col("q") > 0) & is_digits(F.col("codigo"))).join(codes, ["no_doc", "codigo"], "left_anti")
    name = lambda df: F.col("nombre_producto") if "nombre_producto" in df.columns else F.lit(None).cast("string")
    listed = ledger.where(is_digits(F.col("codigo"))).select("no_doc", F.col("codigo").alias("new_code"), F.col("q").alias("q_ext"), name(ledger).alias("name_ext"))
    met = unknown.join(listed, "no_doc").where(F.abs(F.col("q_ext") - F.col("q")) <= TOLERANCE)
    edit = one_edit_apart(F.col("codigo"), F.col("new_code"))
    if not fuzzy:
        return met.where(edit).select("row_seq", "no_doc", "codigo", "q", "new_code", F.lit(1.0).alias("score"), F.lit(True).alias("strong"))
    scored = met.withColumn("alike", seq_ratio("codigo", "new_code")).withColumn("product", description_similarity(name(scan), F.col("name_ext")))
    score = PRODUCT_WEIGHT * F.col("product") + CODE_WEIGHT * F.col("alike")
    judged = scored.withColumn("score", score).withColumn("strong", edit | (F.col("alike") >= STRONG_CODE))
    return judged.where(F.col("strong") | ((F.col("product") >= PRODUCT) & (F.col("score") >= SCORE))).select("row_seq", "no_doc", "codigo", "q", "new_code", "score", "strong")


def choose_codes(candidates: DataFrame) -> DataFrame:
    """The candidate that clearly leads, if one does."""
    order = W.partitionBy("row_seq").orderBy(F.desc("strong"), F.desc("score"), "new_code")
    ranked = candidates.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead(F.struct("strong", "score")).over(order)).where("r = 1")
    clear = F.when(F.col("strong"), ~F.col("next.strong")).otherwise(F.col("score") - F.col("next.score") >= SCORE_LEAD)
    return ranked.where(F.col("next").isNull() | clear).drop("r", "next")


def repair_codes(ledger: DataFrame, scan: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Corrects codes; a reading whose code is there already, with the same
    quantity, is a second reading of one line and goes."""
    chosen = keep(choose_codes(code_candidates(ledger, scan, fuzzy)).select("row_seq", "no_doc", "new_code", "q"), "chosen")
    present = scan.where("q is not null").select("no_doc", F.col("codigo").alias("new_code"), F.col("q").alias("q_there"))
    there = chosen.join(present, ["no_doc", "new_code"]).where(F.abs(F.col("q_there") - F.col("q")) <= TOLERANCE).select("row_seq").distinct().withColumn("there", F.lit(True))
    turn = F.row_number().over(W.partitionBy("no_doc", "new_code", "q").orderBy("row_seq"))
    decided = chosen.withColumn("turn", turn).join(there, "row_seq", "left").select("row_seq", "new_code", (F.coalesce("there", F.lit(False)) | (F.col("turn") > 1)).alias("gone"))
    met = scan.join(decided, "row_seq", "left").where(~F.coalesce("gone", F.lit(False)))
    return met.withColumn("codigo", F.coalesce("new_code", "codigo")).drop("new_code", "gone")
