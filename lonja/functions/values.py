"""Scalar building blocks, all native expressions: dates in several writings, aliases, flags, shapes, hashes."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Date patterns in the order in which they are tried; the order decides what 03/04/2025 means.
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]
# Accented letters and their plain forms.
ACCENTED, PLAIN = "ÁÉÍÓÚÜÑáéíóúüñ", "AEIOUUNaeiouun"
_FOLD = str.maketrans(ACCENTED, PLAIN)
_KEPT = frozenset(string.ascii_uppercase + string.digits)
# Fixed value: what the address rule of the sales layers accepts.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def multi_format_date(c: Column, patterns: list[str] | None = None) -> Column:
    """The first pattern that reads the text wins; null if none does."""
    return F.coalesce(*[F.try_to_date(c, p) for p in patterns or DATE_PATTERNS])


def accent_fold(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def alias_key(c: Column) -> Column:
    """Upper case, without accents, letters and digits only."""
    return F.regexp_replace(F.upper(F.trim(accent_fold(c))), "[^A-Z0-9]", "")


def alias_key_of(text: str) -> str:
    """The same key of a value on the driver, by the same table of letters."""
    return "".join(ch for ch in text.translate(_FOLD).strip(" ").upper() if ch in _KEPT)


def map_aliases(df: DataFrame, column: str, aliases: dict[str, str], default: str, out: str) -> DataFrame:
    """``out`` is the canonical name of each value, ``default`` where there is none. A lookup in one map literal."""
    table = {alias_key_of(k): v for k, v in aliases.items()}
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    return df.withColumn(out, F.coalesce(F.try_element_at(m, alias_key(F.col(column))), F.lit(default)))


def number(c: Column) -> Column:
    return c.try_cast("double")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | (F.lower(c) == "null")


def email_valid(c: Column) -> Column:
    """Null stays null."""
    return c.rlike(EMAIL)


def first_digits(c: Column) -> Column:
    """'' without a digit; null stays null."""
    return F.regexp_extract(c, r"(\d+)", 1)


def date_shape(c: Column) -> Column:
    """The patterns of DATE_PATTERNS that a text is shaped like, 'other' for none; digits are all alike in a shape."""
    shapes: dict[str, list[str]] = {}
    for p in DATE_PATTERNS:
        shapes.setdefault(re.sub("[A-Za-z]", "9", p), []).append(p.lower())
    labels = F.create_map(*[F.lit(x) for shape, ps in shapes.items() for x in (shape, " or ".join(ps))])
    return F.coalesce(F.try_element_at(labels, F.regexp_replace(c, r"\d", "9")), F.lit("other"))


def seller_shape(c: Column) -> Column:
    return F.when(c.isNull(), "null").when(c.startswith("VEN-"), "VEN-").when(c.startswith("v"), "v").when(c.rlike(r"^\d+$"), "digits").otherwise("other")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9áéíóúüñäöß]+"), lambda x: x != "")


def fingerprint(*cols: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, digits)


def day_of_iso(c: Column) -> Column:
    return F.substring(c, 1, 10)
