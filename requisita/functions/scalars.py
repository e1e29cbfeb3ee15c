"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a number looks like; keeps out Java's suffixes ("1d") and "NaN".
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ITEM_CODE = r"^[0-9]{6,10}$"
POSITION_TAG = r"^[\(\[][0-9]+[-–]?[0-9]*[\)\]]$"
#: Letters that Unicode folds to a plain one, and their plain ones.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑáàâäãåéèêëíìîïóòôöõúùûüçñ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNaaaaaaeeeeiiiiooooouuuucn"
TOLERANCE = 1e-6


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def clean_id(c: Column, kind: str = "string") -> Column:
    """Ids are text: null is empty, whole numbers lose their fraction."""
    if kind in ("double", "float"):
        whole = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        return F.coalesce(F.when(F.isnan(c), F.lit("")).otherwise(whole), F.lit(""))
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def to_number(c: Column) -> Column:
    """Quantity text as a double: commas and bars go, anything else is null."""
    s = strip(F.regexp_replace(c.cast("string"), "[,|]", ""))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_digits(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def one_edit_apart(a: Column, b: Column) -> Column:
    """One substitution, insertion or deletion, exactly."""
    return F.levenshtein(a, b) == 1


def hamming(a: Column, b: Column) -> Column:
    """Differing places of texts of equal length; null for other pairs."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.when(F.length(a) == F.length(b), F.size(F.filter(pairs, lambda p: p["x"] != p["y"])))


def abbreviates(a: Column, b: Column) -> Column:
    """Either is the end of the other."""
    return F.endswith(a, b) | F.endswith(b, a)


def is_position_tag(c: Column) -> Column:
    return c.rlike(POSITION_TAG)


def looks_like_doc_number(c: Column) -> Column:
    return F.length(digits(F.coalesce(c, F.lit("")))) >= 6


def normal_text(c: Column) -> Column:
    """Capital letters and digits of Latin text, words joined by one space."""
    plain = F.upper(F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN))
    return F.array_join(F.regexp_extract_all(plain, F.lit("([A-Z0-9]+)"), 1), " ")


def token_overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller set of words; 0 if either is empty."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(share)


def filename_doc(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, r"^([0-9]{6,10})", 1))


#: How a day, and a year at the end, stand in a file name.
DAY_LONG = r"(?<![0-9])([0-9]{1,2})[.-]([0-9]{1,2})[.-]([0-9]{4}|[0-9]{2})(?![0-9])"
DAY_SHORT = r"(?<![0-9])([0-9]{1,2})[.-]([0-9]{2})([0-9]{2})(?![0-9])"
YEAR_LAST = r"[.-]([0-9]{4}|[0-9]{2})(?=[^0-9]*$)"


def _century(c: Column) -> Column:
    """Two digits of a year at the start become four."""
    return F.regexp_replace(c, "^([0-9]{2})(-|$)", "20$1$2")


def date_from_filename(c: Column) -> Column:
    """The day in a name: DD.MM.YYYY or DD-MM-YY, else DD.MMYY.  The first
    pattern that matches decides, even if its day does not exist."""
    found = [null_if_empty(F.regexp_replace(F.regexp_extract(c, p, 0), p, "$3-$2-$1")) for p in (DAY_LONG, DAY_SHORT)]
    return F.try_to_date(_century(F.coalesce(*found)), "yyyy-M-d")


def date_range_from_filename(c: Column) -> Column:
    """struct(start, end, label): a day, or else the year at the end of the name."""
    year = _century(F.regexp_extract(c, YEAR_LAST, 1)).try_cast("int")
    whole = F.when(year.between(2000, 2100), year)
    pick = F.struct(date_from_filename(c).alias("day"), whole.cast("string").alias("year"))
    # the struct is made once, and the three fields read it
    return F.element_at(
        F.transform(
            F.array(pick),
            lambda p: F.when(p["day"].isNotNull(), F.struct(p["day"].alias("start"), p["day"].alias("end"), F.date_format(p["day"], "dd.MM.yyyy").alias("label"))).when(
                p["year"].isNotNull(),
                F.struct(F.try_to_date(F.concat(p["year"], F.lit("-01-01")), "yyyy-MM-dd").alias("start"), F.try_to_date(F.concat(p["year"], F.lit("-12-31")), "yyyy-MM-dd").alias("end"), F.concat(F.lit("año "), p["year"]).alias("label")),
            ),
        ),
        1,
    )


def pick_best_quantity(a: Column, b: Column) -> Column:
    """Of two readings: the numeric one, the shorter of two, else the first."""
    na, nb = is_digits(a), is_digits(b)
    first = F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    return F.when(na & nb, F.when(F.length(a) <= F.length(b), a).otherwise(b)).when(na, a).when(nb, b).otherwise(first)


def needs_refinement(current: Column, asked: Column) -> Column:
    """Whether a quantity should be read again."""
    return ~is_digits(current) | (F.length(current) >= 4) | ~is_digits(asked) | (current != asked)


def accept_local_cell(current: Column, local: Column, asked: Column) -> Column:
    """The quantity after a second local reading."""
    usable = is_digits(local) & needs_refinement(current, asked)
    better = ~is_digits(current) | (F.length(local) < F.length(current)) | ((F.length(local) == F.length(current)) & ~is_digits(asked))
    return F.when(usable & better, local).otherwise(current)


def receipt_quantity(c: Column) -> Column:
    """Quantity text of a receipt: comma as point, thousands joined, ".0" off."""
    s = F.replace(strip(c), F.lit(","), F.lit("."))
    return F.when(s.rlike(r"^[0-9]{1,3}\.[0-9]{3}$"), F.replace(s, F.lit("."), F.lit(""))).when(F.endswith(s, F.lit(".0")), F.regexp_replace(s, r"\.0$", "")).when(s.rlike(r"^[0-9]+(\.[0-9]+)?$"), s)


def resolve_doc_number(name: Column, local: Column, model: Column) -> Column:
    """struct(no_doc, source): consensus of file name, local reading and model.

    A reading is *abbreviated* by a shorter text that it ends with; a full
    number beats its abbreviation, agreement beats a single source, and a
    reading far from the name of the file is not trusted.
    """
    name, local, model = (null_if_empty(x) for x in (name, local, model))
    has_name, has_local, has_model = name.isNotNull(), local.isNotNull(), model.isNotNull()

    def full(reading, short):
        return (F.length(reading) > F.length(short)) & F.endswith(reading, short)

    def given(doc, source):
        return F.struct(doc.alias("no_doc"), F.lit(source).alias("source"))

    sure = lambda c: F.coalesce(c, F.lit(False))
    agreed = sure(model == local)
    far = sure(has_name & ~abbreviates(model, name) & (F.coalesce(hamming(name, model), F.lit(99)) > 2))
    local_full = sure(full(local, name))
    return (
        F.when(agreed & far, given(name, "nombre archivo (descarta lectura sospechosa)"))
        .when(agreed, given(model, "gemini + OCR local"))
        .when(local_full & ~has_model, given(local, "OCR local (número completo)"))
        .when(local_full & sure(F.endswith(local, model)), given(local, "OCR local (número completo, Gemini abreviado)"))
        .when(sure(full(model, name)) & ~has_local, given(model, "gemini (número completo)"))
        .when(sure(full(model, name)) & ~sure(F.endswith(local, name)), given(model, "gemini (número completo, OCR local incoherente)"))
        .when(sure(model == name), given(model, "gemini + nombre archivo"))
        .when(sure(local == name), given(local, "OCR local + nombre archivo"))
        .when(has_model & has_name, given(name, "nombre archivo (Gemini sin consenso)"))
        .when(has_model, given(model, "gemini"))
        .when(~has_local, given(name, "nombre_archivo"))
        .when(sure(hamming(name, local) == 1), given(name, "nombre archivo (corrige OCR)"))
        .otherwise(given(local, "OCR local"))
    )


def agreement(a: Column, b: Column) -> Column:
    """Whether two readings agree; null unless both are there."""
    a, b = null_if_empty(a), null_if_empty(b)
    return F.when(a.isNotNull() & b.isNotNull(), a == b)
