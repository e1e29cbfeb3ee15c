"""Spatial queries over recognised words.

Every query is an equi-join on the page with a range condition above it, so work
is bounded by the square of a page's tokens; pages are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import is_position_tag, strip_chars

PAGE = "file_id"
#: Words that are labels and never part of a name.
NOISE = ("NOMBRE", "FIRMA", "FECHA", "INFORMACION", "DOC", "DOCUMENTOS", "ELABORADO", "SAFIS", "GENERADOS")
ROW_GAP = 22
MIN_CONFIDENCE = 30
ANCHOR = ["tok_seq", "x", "y", "x2", "y2", "cx", "cy"]


def confident(raw: DataFrame, least: int = MIN_CONFIDENCE) -> DataFrame:
    """Words with text and confidence; a confidence that is no number is -1."""
    conf = F.coalesce(F.col("conf").cast("string").try_cast("double").cast("int"), F.lit(-1))
    return raw.withColumn("text", F.trim("text")).where((F.length("text") > 0) & (conf >= least))


def page_extent(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(PAGE).agg(F.max("x2").alias("page_w"), F.max("y2").alias("page_h"))


def has_all(words) -> Column:
    """Whether the capitalised text holds each word."""
    found = F.lit(True)
    for w in words:
        found = found & F.contains(F.upper("text"), F.lit(w.upper()))
    return found


def anchors(tokens: DataFrame, fields: dict[str, list[str]], within: Column | None = None) -> DataFrame:
    """file_id, field, a_*: the first token, in reading order, that holds all
    words of a field; ``within`` restricts tokens."""
    if within is not None:
        tokens = tokens.where(within)
    marks = F.array(*[F.when(has_all(words), F.lit(name)) for name, words in fields.items()])
    any_mark = F.lit(False)
    for words in fields.values():
        any_mark = any_mark | has_all(words)
    # by the text alone, so this goes below a join that ``within`` needs
    marked = tokens.where(any_mark).select(PAGE, *ANCHOR, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("field"))
    return marked.groupBy(PAGE, "field").agg(F.min_by(F.struct(*ANCHOR), "tok_seq").alias("a")).select(PAGE, "field", *[F.col(f"a.{c}").alias(f"a_{c}") for c in ANCHOR])


def met(tokens: DataFrame, found: DataFrame) -> DataFrame:
    return tokens.join(found, PAGE).where("tok_seq <> a_tok_seq")


def value_below(tokens: DataFrame, found: DataFrame, max_dy: int = 180, max_dx: int = 80) -> DataFrame:
    """file_id, field, value: nearest token under each anchor."""
    dy, dx = F.col("y") - F.col("a_y2"), F.abs(F.col("cx") - F.col("a_cx"))
    near = met(tokens, found).where((dy >= 0) & (dy <= max_dy) & (dx <= max_dx) & ~is_position_tag(F.col("text")))
    return near.groupBy(PAGE, "field").agg(F.min_by("text", F.struct(dy, F.col("tok_seq"))).alias("value"))


def value_right(tokens: DataFrame, found: DataFrame, max_dx: int = 500, max_dy: int = 20) -> DataFrame:
    """file_id, field, value: nearest token on the right of each anchor."""
    dx, dy = F.col("x") - F.col("a_x2"), F.abs(F.col("cy") - F.col("a_cy"))
    near = met(tokens, found).where((dx >= 0) & (dx <= max_dx) & (dy <= max_dy))
    return near.groupBy(PAGE, "field").agg(F.min_by("text", F.struct(dx, F.col("tok_seq"))).alias("value"))


def _joined(texts: Column, chars: str) -> Column:
    return F.nullif(strip_chars(F.array_join(texts, " "), chars), F.lit(""))


def line_below(tokens: DataFrame, found: DataFrame, max_dy: int = 140, left: int = -40, right: int = 440, tolerance: int = 25) -> DataFrame:
    """file_id, field, value: the words of the first line under each anchor."""
    dy = F.col("y") - F.col("a_y2")
    word = strip_chars(F.upper("text"), " :.")
    noise = F.lit(False)
    for n in NOISE:
        noise = noise | F.contains(word, F.lit(n))
    near = met(tokens, found).where((dy > 0) & (dy <= max_dy) & F.col("cx").between(F.col("a_x") + left, F.col("a_x") + right) & ~noise & ~word.isin("POR", ""))
    top = F.min("y").over(W.partitionBy(PAGE, "field"))
    line = near.withColumn("top", top).where(F.abs(F.col("y") - F.col("top")) < tolerance)
    ordered = F.array_sort(F.collect_list(F.struct("x", "y", "tok_seq", "text")))
    return line.groupBy(PAGE, "field").agg(_joined(F.transform(ordered, lambda t: t["text"]), " :").alias("value"))


def line_right(tokens: DataFrame, found: DataFrame, max_dx: int = 600, tolerance: int = 25) -> DataFrame:
    """file_id, field, value: the words on the right of each anchor."""
    dx = F.col("x") - F.col("a_x2")
    near = met(tokens, found).where((dx >= 0) & (dx <= max_dx) & (F.abs(F.col("cy") - F.col("a_cy")) <= tolerance) & ~strip_chars(F.col("text"), " :.").isin("", "-"))
    ordered = F.array_sort(F.collect_list(F.struct("x", "tok_seq", "text")))
    return near.groupBy(PAGE, "field").agg(_joined(F.transform(ordered, lambda t: strip_chars(t["text"], ":")), " ").alias("value"))


def group_rows(tokens: DataFrame, gap: int = ROW_GAP) -> DataFrame:
    """Adds ``row``: tokens in order of height, a new row at each gap."""
    order = W.partitionBy(PAGE).orderBy("cy", "tok_seq")
    new = F.coalesce((F.col("cy") - F.lag("cy").over(order) >= gap).cast("int"), F.lit(0))
    return tokens.withColumn("_new", new).withColumn("row", F.sum("_new").over(order)).drop("_new")


def split_rows(rows: DataFrame, is_code: Column) -> DataFrame:
    """Adds ``part``: a row with several codes is cut half-way between them."""
    height = F.sort_array(F.collect_list(F.when(is_code, F.col("cy"))).over(W.partitionBy(PAGE, "row")))
    cuts = F.transform(F.slice("_codes", F.lit(1), F.greatest(F.size("_codes") - 1, F.lit(0))), lambda c, i: (c + F.element_at("_codes", i + 2)) / 2)
    return rows.withColumn("_codes", height).withColumn("_cuts", cuts).withColumn("part", F.size(F.filter("_cuts", lambda m: m <= F.col("cy")))).drop("_codes", "_cuts")


def column_of(layout: Column, place: Column) -> Column:
    """Name of the first column that holds a place (a share of the width)."""
    return F.get(F.filter(layout, lambda c: (c["lo"] <= place) & (place < c["hi"])), F.lit(0))["col"]
