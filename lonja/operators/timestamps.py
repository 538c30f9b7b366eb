"""Normalisation of mixed timestamp writings to one UTC instant (problem 1).

Written times become calendar fields by one pattern per family of writings, all on the JVM side. Fields become
microseconds on a local clock. What carries its own offset is an instant at once; the rest is matched as-of
against the offset intervals of its zone: two intervals hold a time that occurs twice, none a time that never
occurs, exactly one gives the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.timezones import with_interval_key, zone_offset_intervals

# Month names of Spanish, English and German by number.
MONTHS = {
    1: ["ene", "enero", "jan", "january", "januar"],
    2: ["feb", "febrero", "february", "februar"],
    3: ["mar", "marzo", "march", "mär", "märz"],
    4: ["abr", "abril", "apr", "april"],
    5: ["may", "mayo", "mai"],
    6: ["jun", "junio", "june", "juni"],
    7: ["jul", "julio", "july", "juli"],
    8: ["ago", "agosto", "aug", "august"],
    9: ["sep", "sept", "septiembre", "setiembre", "set", "september"],
    10: ["oct", "octubre", "october", "okt", "oktober"],
    11: ["nov", "noviembre", "november"],
    12: ["dic", "diciembre", "dec", "december", "dez", "dezember"],
}
# Hours from UTC of the zone abbreviations that are understood.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3,
    "COT": -5, "PET": -5, "ECT": -5, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7, "CLT": -4, "CLST": -3, "VET": -4, "BOT": -4, "ART": -3, "BRT": -3, "UYT": -3, "PYT": -4,
}

_TIME = r"(?:[T ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
_AMPM = r"(?:\s*([AaPp])\.?\s*[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z_/+\-0-9]+)?"
_WORD = r"([\p{L}]{3,10})\.?"
# (pattern, canonical writing "year|month|day|hour|minute|second|fraction|a or p|zone")
_YMD = (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}{_AMPM}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9")
_NUMERIC = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}{_AMPM}{_ZONE}$"
_DMY = (_NUMERIC, "$3|$2|$1|$4|$5|$6|$7|$8|$9")
_MDY = (_NUMERIC, "$3|$1|$2|$4|$5|$6|$7|$8|$9")
_DAY_WORD = (
    rf"^(?:[\p{{L}}]{{2,10}}\.?,?\s+)?(\d{{1,2}})(?:[- ]+|\s+de\s+|\.\s*){_WORD}(?:[- ]+|\s+del?\s+|,\s*)(\d{{4}}){_TIME}{_AMPM}{_ZONE}$",
    "$3|$2|$1|$4|$5|$6|$7|$8|$9",
)
_WORD_DAY = (rf"^(?:[\p{{L}}]{{2,10}},\s+)?{_WORD}\s+(\d{{1,2}}),?\s+(\d{{4}}){_TIME}{_AMPM}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9")
_RUN = (r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?)?(Z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|||$7")

_US = 1_000_000
_DAY_US = 86_400 * _US


def _fields(t: Column, order: Column) -> Column:
    def made(rule: tuple[str, str]) -> Column:
        return F.regexp_replace(t, rule[0], rule[1])

    numeric = t.rlike(_NUMERIC)
    lead = F.substring(t, 1, 1).between("0", "9")
    return (
        F.when(t.rlike(_YMD[0]), made(_YMD))
        .when(numeric & (order == "MDY"), made(_MDY))
        .when(numeric & (order == "DMY"), made(_DMY))
        .when(lead & t.rlike(r"^(\d{8}|\d{12}|\d{14})$|^\d{8}T") & t.rlike(_RUN[0]), made(_RUN))
        .when(t.rlike(_DAY_WORD[0]), made(_DAY_WORD))
        .when(~lead & t.rlike(_WORD_DAY[0]), made(_WORD_DAY))
    )


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,9}$"), c.try_cast("int"))


def normalise_timestamps(df: DataFrame, id_col: str, value_col: str, zone_col: str, order_col: str) -> DataFrame:
    """One row for each input row: ``id_col``, ``instant_us`` (long, microseconds since 1970-01-01 UTC) and ``status``.

    ``zone_col`` holds the IANA name of the clock the value was written by, ``order_col`` 'DMY' or 'MDY'. Any
    other column of ``df`` is ignored, whatever its name. ``status`` is 'ok', 'missing' (null, empty),
    'unreadable' (no known writing, an impossible date, an unknown zone), 'twice' or 'never'; ``instant_us`` is null unless
    'ok'. Years are 1 to 9999. Rows repeated in
    the input are repeated in the result; an empty table gives an empty result. A null zone or order only
    matters to values that need it.
    """
    names = {m: n for n, all_ in MONTHS.items() for m in all_}
    month_map = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    abbr_map = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    src = df.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.col(value_col), r"^[\s ​﻿]+|[\s ​﻿]+$", "").alias("t"),
        F.col(zone_col).alias("zone"), F.upper(F.col(order_col)).alias("ord"),
    )
    src = src.select("id", "t", "zone", F.split(_fields(F.col("t"), F.col("ord")), r"\|", -1).alias("f"))
    f = lambda k: F.col("f")[k]
    src = src.select(
        "id", "t", "zone", "f",
        F.when(F.length(f(0)) == 2, F.lit(2000) + _int(f(0))).otherwise(_int(f(0))).alias("y"),
        F.coalesce(_int(f(1)), F.try_element_at(month_map, F.lower(f(1)))).alias("m"), _int(f(2)).alias("d"),
        F.when(f(3) == "", 0).otherwise(_int(f(3))).alias("h0"), F.when(f(4) == "", 0).otherwise(_int(f(4))).alias("mi"),
        F.when(f(5) == "", 0).otherwise(_int(f(5))).alias("s"), F.substring(F.rpad(f(6), 6, "0"), 1, 6).cast("int").alias("us"),
        F.lower(f(7)).alias("ap"), f(8).alias("z"),
    )
    y, m, d, h0, ap, z = (F.col(c) for c in ("y", "m", "d", "h0", "ap", "z"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    hour = F.when((ap != "") & h0.between(1, 12), h0 % 12 + F.when(ap == "p", 12).otherwise(0)).when(ap == "", h0)
    good = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= longest) & hour.between(0, 23) & F.col("mi").between(0, 59) & F.col("s").between(0, 59)
    one = F.lit(1)
    days = F.unix_date(F.make_date(F.when(good, y).otherwise(2000), F.when(good, m).otherwise(one), F.when(good, d).otherwise(one)))
    clock = days.cast("long") * _DAY_US + (hour * 3600 + F.col("mi") * 60 + F.col("s")).cast("long") * _US + F.col("us")
    t = F.col("t")
    serial = F.when(t.rlike(r"^\d{5}(\.\d{1,10})?$"), t.try_cast("double"))
    serial_us = (F.floor(serial) - 25569).cast("long") * _DAY_US + F.round((serial - F.floor(serial)) * 86400).cast("long") * _US
    unix = F.when(t.rlike(r"^\d{10}$"), t.try_cast("long") * _US).when(t.rlike(r"^\d{13}$"), t.try_cast("long") * 1000).when(t.rlike(r"^\d{10}\.\d{1,6}$"), (t.try_cast("decimal(20,6)") * _US).cast("long"))
    signed = z.rlike(r"^[+-]\d{2}(:?\d{2})?$")
    digits = F.rpad(F.regexp_replace(z, r"[^0-9]", ""), 4, "0")
    off_s = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    printed = F.when(signed, F.when(F.substring(z, 1, 1) == "-", -off_s).otherwise(off_s)).otherwise(F.try_element_at(abbr_map, F.upper(z)) * 3600)
    src = src.select(
        "id", "t",
        F.coalesce(unix, F.when(good & (z != "") & (F.instr(z, "/") == 0), clock - printed.cast("long") * _US)).alias("abs_us"),
        F.when(good & ((z == "") | (F.instr(z, "/") > 0)), clock).otherwise(serial_us).alias("local_us"),
        F.when(F.instr(z, "/") > 0, z).otherwise(F.col("zone")).alias("tz_zone"),
    )
    # One struct for each row, opened again: what was parsed so far is computed once and not written out in what follows.
    src = src.select(F.inline(F.array(F.struct("id", "t", "abs_us", F.when(F.col("abs_us").isNull(), F.col("local_us")).alias("local_us"), "tz_zone"))))
    src = with_interval_key(src, "local_us")
    # A table of the zone database, whatever the data: see zone_offset_intervals.
    zones = F.broadcast(zone_offset_intervals(df.sparkSession))
    got = src.join(zones, ["tz_zone", "tz_key"], "left")
    hits = F.filter("tz_intervals", lambda i: (F.col("moved_us") >= i["from_us"]) & (F.col("moved_us") < i["to_us"]))
    got = got.select("id", "t", "abs_us", "local_us", "tz_intervals", hits.alias("hits"))
    resolved = F.coalesce(F.col("abs_us"), F.when(F.size("hits") == 1, F.col("local_us") - F.col("hits")[0]["offset_us"]))
    status = (
        F.when(F.col("t").isNull() | (F.col("t") == ""), "missing")
        .when(F.col("abs_us").isNotNull(), "ok")
        .when(F.col("local_us").isNull() | F.col("tz_intervals").isNull(), "unreadable")
        .when(F.size("hits") == 1, "ok").when(F.size("hits") > 1, "twice").otherwise("never")
    )
    return got.select(F.col("id").alias(id_col), resolved.alias("instant_us"), status.alias("status"))
