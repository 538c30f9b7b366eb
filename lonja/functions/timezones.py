"""Offset intervals of the IANA zones on the local clock, exploded by spans of years, for times of any year."""

from __future__ import annotations

import bisect
import os
import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UTC = timezone.utc
_EPOCH = datetime(1970, 1, 1, tzinfo=_UTC)
_EVER = 1 << 61
_DAY_US = 86_400_000_000
#: No zone changed its clock before the first year. After the last one the rules of a zone repeat; the 28 years up to it hold every kind of year.
FIRST_YEAR, LAST_YEAR = 1840, 2130
#: Years of one key: five in these years, else ten.
FIVE_YEARS = (1970, 2039)


def _offset_s(zone: zoneinfo.ZoneInfo, utc_s: int) -> int:
    off = datetime.fromtimestamp(utc_s, zone).utcoffset()
    return off.days * 86400 + off.seconds


def _file(name: str) -> bytes:
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, *name.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def _listed(raw: bytes) -> tuple[list[int], bool]:
    """The instants of change that a TZif file (RFC 9636) lists, and whether a yearly rule follows them."""
    counts = lambda at: struct.unpack(">6l", raw[at + 20 : at + 44])
    utc, std, leap, times, types, chars = counts(0)
    at, width = 0, 4
    if raw[4:5] >= b"2":
        at, width = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc, 8
        utc, std, leap, times, types, chars = counts(at)
    body = at + 44
    changes = struct.unpack(f">{times}{'q' if width == 8 else 'l'}", raw[body : body + times * width])
    footer = raw[body + times * (width + 1) + types * 6 + chars + leap * (width + 4) + std + utc :]
    return list(changes), b"," in footer


def _start(year: int) -> int:
    return int((datetime(year, 1, 1, tzinfo=_UTC) - _EPOCH).total_seconds())


def _intervals(name: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(utc start, utc end, offset) in seconds, from ever to the end of the last year."""
    zone = zoneinfo.ZoneInfo(name)
    first, end = _start(FIRST_YEAR), _start(LAST_YEAR + 2)
    changes, ruled = _listed(raw)
    changes = [c for c in changes if first < c < end]
    if ruled:
        # A rule changes the clock at most once in three weeks, on a whole minute, which is searched for.
        at = max([first, *changes])
        off = _offset_s(zone, at)
        while at < end:
            nxt = at + 21 * 86400
            new = _offset_s(zone, nxt)
            if new != off:
                minutes = range(at // 60, nxt // 60 + 1)
                changes.append(minutes[bisect.bisect_left(minutes, True, key=lambda m: _offset_s(zone, m * 60) == new)] * 60)
            at, off = nxt, new
    out, start, off = [], -_EVER // 1_000_000, _offset_s(zone, first)
    for c in sorted(set(changes)):
        new = _offset_s(zone, c)
        if new != off:
            out.append((start, c, off))
            start, off = c, new
    return [*out, (start, end, off)]


def _key_of(year: int) -> int:
    return year // 5 * 5 if FIVE_YEARS[0] <= year <= FIVE_YEARS[1] else year // 10 * 10


@lru_cache(maxsize=4)
def _rows(zones: tuple[str, ...]) -> pa.Table:
    known = zoneinfo.available_timezones()
    names, keys, ends, columns = [], [], [0], ([], [], [])
    same: dict[bytes, dict[int, list]] = {}
    year_of = lambda s: (_EPOCH + timedelta(seconds=s)).year
    for name in zones:
        if name not in known:
            continue
        raw = _file(name)
        if raw not in same:
            by_key: dict[int, list] = {}
            for a, b, off in _intervals(name, raw):
                la, lb = a + off, b + off
                y0 = FIRST_YEAR if la < _start(FIRST_YEAR) else year_of(la)
                for k in sorted({_key_of(y) for y in range(y0, min(LAST_YEAR, year_of(lb - 1)) + 1)}):
                    by_key.setdefault(k, []).append((la * 1_000_000, lb * 1_000_000, off * 1_000_000))
            same[raw] = by_key
        for k, found in same[raw].items():
            names.append(name)
            keys.append(k)
            ends.append(ends[-1] + len(found))
            for column, values in zip(columns, zip(*found)):
                column += values
    one = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["from_us", "to_us", "offset_us"])
    return pa.table({"tz_zone": pa.array(names, pa.string()), "tz_key": pa.array(keys, pa.int32()), "tz_intervals": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one)})


def zone_offset_intervals(spark: SparkSession, zones: list[str] | None = None) -> DataFrame:
    """One row for each zone and ``tz_key`` (see :func:`with_interval_key`) with the offset intervals that touch it on the local clock.

    ``zones`` None takes every zone of the IANA database: its size is a property of that database (about 600 zones times
    40 keys), not of the data or its years, so the table may be broadcast.
    """
    names = tuple(sorted(zones if zones is not None else zoneinfo.available_timezones()))
    return spark.createDataFrame(_rows(names))


def with_interval_key(df: DataFrame, local: str) -> DataFrame:
    """``df`` with ``tz_key`` of a local time in microseconds, and ``moved_us``, the time to look for under it.

    Times after LAST_YEAR are moved, by whole days, to the year of the last 28 that has the same days of the week; earlier
    ones stay where they are, and those before FIRST_YEAR are under its decade. Step by step, so that no expression is repeated in others.
    """
    kinds = {}
    for y in range(LAST_YEAR - 27, LAST_YEAR + 1):
        kinds.setdefault((datetime(y, 1, 1).isoweekday() % 7 + 1) * 2 + (y % 4 == 0), y)
    # A character for each kind of year: its distance from the first of the 28.
    late = F.lit("".join(chr(65 + kinds.get(k, LAST_YEAR) - LAST_YEAR + 27) for k in range(16)))
    new_year = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    y, alike = F.col("tz_year"), F.col("tz_alike")
    out = df.select("*", F.year(F.date_from_unix_date(F.floor(F.col(local) / F.lit(_DAY_US)).cast("int"))).alias("tz_year"))
    leap = F.dayofmonth(F.last_day(F.make_date(y, F.lit(2), F.lit(1)))) - 28
    out = out.select("*", F.when(y > LAST_YEAR, F.ascii(F.substring(late, F.dayofweek(new_year(y)) * 2 + leap + 1, F.lit(1))) - 65 + LAST_YEAR - 27).otherwise(F.greatest(y, F.lit(FIRST_YEAR))).alias("tz_alike"))
    moved = F.col(local) - F.when(y > LAST_YEAR, F.date_diff(new_year(y), new_year(alike))).otherwise(0).cast("long") * F.lit(_DAY_US)
    width = F.when(alike.between(*FIVE_YEARS), 5).otherwise(10)
    return out.select(*df.columns, (alike - alike % width).cast("int").alias("tz_key"), moved.alias("moved_us"))
