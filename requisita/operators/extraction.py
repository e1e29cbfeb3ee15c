"""Readings of one file put together: two resolutions, and an outside model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import null_if_empty
from .dedup import first_of

FIELDS = ("idem", "nombre_producto", "presentacion", "cant_solicitada", "cant_despachada")


def last_reading(items: DataFrame) -> DataFrame:
    """The last row of each code of a file."""
    return first_of(items, ["file_id", "codigo"], F.desc("row_seq"))


def merge_resolutions(low: DataFrame, high: DataFrame, fields=FIELDS) -> DataFrame:
    """Items of either resolution; a row of the lower one wins as a whole, its
    empty texts included."""
    left = low.select("file_id", "codigo", F.struct(*fields).alias("l"))
    right = high.select("file_id", "codigo", F.struct(*fields).alias("r"))
    both = left.join(right, ["file_id", "codigo"], "full_outer").withColumn("v", F.coalesce("l", "r"))
    return both.select("file_id", "codigo", "v.*")


def header_fallback(low: DataFrame, high: DataFrame, number_fields: list[str], read: str = "no_doc") -> DataFrame:
    """The lower resolution's header; all of the other's where it has none, and
    the other's document number fields where it has no number in ``read``."""
    rest = [c for c in low.columns if c != "file_id"]
    left, right = low.select("file_id", F.struct(*rest).alias("l")), high.select("file_id", F.struct(*rest).alias("r"))
    both = left.join(right, "file_id", "full_outer")
    take_number = F.col("l").isNull() | (F.col(f"l.{read}").isNull() & F.col(f"r.{read}").isNotNull())
    pick = lambda c: F.when(take_number if c in number_fields else F.col("l").isNull(), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))
    return both.select("file_id", *[pick(c).alias(c) for c in rest])


def parse_items(reply: Column) -> Column:
    """Array of (codigo, cant_solicitada, cant_despachada) of a reply: a JSON
    array whose bad elements are left out.  A JSON null becomes ``None``, which
    is no number, and a missing field is empty."""
    elements = F.from_json(reply, "array<string>")

    def field(e, name):
        value = F.get_json_object(e, f"$.{name}")
        # get_json_object gives no difference between null and missing
        missing = ~e.rlike(f'"{name}"\\s*:')
        return F.when(missing, F.lit("")).otherwise(F.trim(F.coalesce(value, F.lit("None"))))

    items = F.transform(F.filter(elements, lambda e: e.rlike(r"^\s*\{")), lambda e: F.struct(*[field(e, n).alias(n) for n in ("codigo", "cant_solicitada", "cant_despachada")]))
    return F.filter(items, lambda s: s["codigo"].rlike("^[0-9]{9}$"))


def parse_replies(replies: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """file_id, reply, place and the three fields; codes of the master only, if
    there is one."""
    opened = replies.select("file_id", "reply", F.posexplode(parse_items(F.col("text"))).alias("place", "i")).select("file_id", "reply", "place", "i.*")
    return opened.join(master.select("codigo"), "codigo", "left_semi") if master is not None else opened


def clean_cell(reply: Column) -> Column:
    """First digits of a cell's reading; a cell said to be empty is ''."""
    return F.when(F.contains(F.upper(reply), F.lit("VACIO")), F.lit("")).otherwise(null_if_empty(F.regexp_extract(reply, "([0-9]+)", 1)))


def exact_digits(reply: Column, n: int) -> Column:
    """The digits of a reply, if there are n."""
    d = F.regexp_replace(reply, "[^0-9]", "")
    return F.when(F.length(d) == n, d)


def consensus(claims: DataFrame, expected: DataFrame) -> DataFrame:
    """file_id, codigo and both quantities that an outside model's replies agree
    on: claimed twice at least, with one dispatched quantity that is not empty
    (the first claim is taken, even if its own is empty); else the first complete
    reply that holds the code with a quantity.  claims: file_id, codigo, reply,
    place, cant_solicitada, cant_despachada; expected: file_id, n (items read on
    the page).  A reply is complete with max(3, 70 % of n) rows."""
    order, row = F.struct("reply", "place"), F.struct("cant_solicitada", "cant_despachada")
    claimed = claims.groupBy("file_id", "codigo").agg(F.count(F.lit(1)).alias("times"), F.count_distinct(F.nullif("cant_despachada", F.lit(""))).alias("values"), F.min_by(row, order).alias("v"))
    agreed = claimed.where("times >= 2 and values = 1").select("file_id", "codigo", "v.*")
    sizes = claims.groupBy("file_id", "reply").agg(F.count(F.lit(1)).alias("size")).join(expected, "file_id")
    complete = sizes.where(F.col("size") >= F.greatest(F.lit(3), F.ceil(F.greatest(F.col("n"), F.lit(1)) * 0.7))).select("file_id", "reply")
    first = claims.groupBy("file_id", "reply", "codigo").agg(F.min_by(row, "place").alias("v")).where("v.cant_despachada <> ''")
    held = first.join(complete, ["file_id", "reply"], "left_semi").join(agreed, ["file_id", "codigo"], "left_anti")
    return agreed.unionByName(held.groupBy("file_id", "codigo").agg(F.min_by("v", "reply").alias("v")).select("file_id", "codigo", "v.*"))


def upsert(items: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Items with both quantities of confirmed codes; codes that were not there
    come in."""
    quantities = ("cant_solicitada", "cant_despachada")
    new = confirmed.select("file_id", "codigo", F.struct(*quantities).alias("v"))
    both = items.join(new, ["file_id", "codigo"], "full_outer")
    taken = {q: F.when(F.col("v").isNotNull(), F.col(f"v.{q}")).otherwise(F.col(q)) for q in quantities}
    return both.withColumns(taken).drop("v")
