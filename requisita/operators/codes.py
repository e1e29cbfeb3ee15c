"""Material codes: cleaning, and repair of misread digits against the master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip

#: First digits of codes, and which digits a digit is misread for.
PREFIXES = ("100", "101", "130", "170", "181", "910")
CONFUSIONS = {"0": "9863", "1": "7", "2": "", "3": "85", "4": "9", "5": "638", "6": "805", "7": "1", "8": "063", "9": "048"}
LENGTH = 9


def material_master(df: DataFrame) -> DataFrame:
    """codigo: distinct codes of a master table, from its column ``Codigo`` or
    else its first."""
    names = {c.strip(): c for c in df.columns}
    column = names.get("Codigo", df.columns[0])
    c = F.col(f"`{column}`")
    text = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")) if dict(df.dtypes)[column] in ("double", "float") else strip(c.cast("string"))
    return df.select(text.alias("codigo")).where(F.col("codigo").rlike("^[0-9]+$")).distinct()


def windows(s: Column, size: int = LENGTH) -> Column:
    """All substrings of a length; none of a shorter text."""
    return F.when(F.length(s) >= size, F.transform(F.sequence(F.lit(1), F.length(s) - (size - 1)), lambda i: F.substring(s, i, size))).otherwise(F.array().cast("array<string>"))


def neighbours(code: Column) -> Column:
    """Codes with one digit replaced by one that it is misread for, in order of
    place and likelihood."""
    likely = F.create_map(*[F.lit(x) for pair in CONFUSIONS.items() for x in pair])

    def at(i):
        others = F.element_at(likely, F.substring(code, i, 1))
        return F.transform(F.filter(F.split(others, ""), lambda d: d != ""), lambda d: F.overlay(code, d, i, F.lit(1)))

    return F.when(F.length(code) == LENGTH, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LENGTH)), at))).otherwise(F.array().cast("array<string>"))


def candidates(runs: Column, whole: Column) -> Column:
    """Array of (stage, place, code, listed): what a reading with these runs of
    digits may mean, best first; ``listed`` ones count only if the master has
    them."""
    nine = F.filter(runs, lambda t: F.length(t) == LENGTH)
    parts = windows(whole)
    known = lambda a: F.filter(a, lambda t: F.substring(t, 1, 3).isin(*PREFIXES))
    first = F.when(F.length(whole) >= 6, F.array(F.substring(whole, 1, 10))).otherwise(F.array().cast("array<string>"))
    repaired = lambda a: F.flatten(F.transform(a, neighbours))
    stages = [(nine, True), (parts, True), (repaired(nine), True), (repaired(parts), True), (known(nine), False), (nine, False), (known(parts), False), (first, False)]

    def marked(n, codes, listed):
        return F.transform(codes, lambda c, i: F.struct(F.lit(n).alias("stage"), i.alias("place"), c.alias("code"), F.lit(listed).alias("listed")))

    return F.concat(*[marked(n, codes, listed) for n, (codes, listed) in enumerate(stages)])


def first_valid(df: DataFrame, key: list[str], options: Column, master: DataFrame) -> DataFrame:
    """key, codigo, verified: the first option that holds.  Options meet the
    master in an equi-join."""
    opened = df.select(*key, F.explode(options).alias("o")).select(*key, "o.*")
    met = opened.join(master.select(F.col("codigo").alias("code"), F.lit(True).alias("in_master")), "code", "left").withColumn("in_master", F.coalesce("in_master", F.lit(False)))
    rank = F.struct("stage", "place")
    held = met.where("in_master or not listed")
    return held.groupBy(*key).agg(F.min_by("code", rank).alias("codigo"), F.min_by("in_master", rank).alias("verified"))


def clean_codes(df: DataFrame, key: list[str], raw: str, master: DataFrame) -> DataFrame:
    """key, codigo (null where nothing is one), verified.  Each distinct reading
    is looked up once."""
    reading = F.coalesce(F.col(raw), F.lit(""))
    distinct = df.select(reading.alias("_raw")).distinct()
    parts = distinct.withColumn("_runs", F.regexp_extract_all("_raw", F.lit("([0-9]+)"), 1)).withColumn("_whole", F.array_join("_runs", ""))
    found = first_valid(parts, ["_raw"], candidates(F.col("_runs"), F.col("_whole")), master)
    met = df.select(*key, reading.alias("_raw")).join(found, "_raw", "left").drop("_raw")
    return met.withColumn("verified", F.coalesce("verified", F.lit(False)))


def recover_codes(df: DataFrame, key: list[str], code: str, master: DataFrame) -> DataFrame:
    """key, codigo: the first one-digit repair that the master has."""
    options = F.transform(neighbours(F.col(code)), lambda c, i: F.struct(F.lit(0).alias("stage"), i.alias("place"), c.alias("code"), F.lit(True).alias("listed")))
    return first_valid(df, key, options, master).drop("verified")
