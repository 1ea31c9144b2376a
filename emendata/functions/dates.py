"""Dates as feeds write them, to an instant and whether the publisher wrote an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zones by name and their offsets.
ZONES = {
    "UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Seconds that a date may lie after its retrieval.
SKEW = 3600

_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2})?)"
ISO = rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:T(\d{{2}}):(\d{{2}})(?::(\d{{2}}))?(\.\d{{0,9}})?{_OFFSET}?)?$"
#: Weekday, day, month, year, time, offset of letters or digits.
RFC = rf"(?i)^(?:(mon|tue|wed|thu|fri|sat|sun),? )?(\d{{1,2}}) ({'|'.join(MONTHS)}) (\d{{4}}|\d{{2}}) (\d{{2}}):(\d{{2}})(?::(\d{{2}}))?(?: {_OFFSET}?)?$"


def cleaned(raw: Column) -> Column:
    """Single spaces, no comment at the end, zones by name as offsets; unknown names of zones go."""
    x = F.trim(F.regexp_replace(raw, r"\s+", " "))
    x = F.regexp_replace(x, r"\s*\([^()]*\)\s*$", "")
    x = F.regexp_replace(x, r"(?i)\bGMT\s*(?=[+-]\d)", "")
    x = F.regexp_replace(x, r"^(\d{4}-\d{2}-\d{2}) (\d{2}:)", "$1T$2")
    name = F.upper(F.regexp_extract(x, r"\s([A-Za-z]{1,5})$", 1))
    bare = F.regexp_replace(x, r"\s+[A-Za-z]{1,5}$", "")
    zones = F.create_map(*[F.lit(v) for kv in ZONES.items() for v in kv])
    return F.when(name == "", x).otherwise(F.concat(bare, F.coalesce(F.concat(F.lit(" "), F.element_at(zones, name)), F.lit(""))))


def _seconds(offset: Column) -> Column:
    digits = F.rpad(F.regexp_replace(offset, "[^0-9]", ""), 4, "0")
    size = F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60
    return F.when((offset == "") | (F.upper(offset) == "Z"), 0).when(offset.startswith("-"), -size).otherwise(size)


def _instant(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, fraction: Column, offset: Column) -> Column:
    """The instant in UTC; null for days and times that do not exist."""
    blank = lambda x: F.when(x == "", "0").otherwise(x).cast("int")
    day = F.try_make_timestamp(y.cast("int"), mo.cast("int"), d.cast("int"), blank(h), blank(mi), (blank(s)).cast("decimal(8,6)"), F.lit("UTC"))
    valid = (blank(h) < 24) & (blank(mi) < 60) & (blank(s) < 60)
    tiny = F.when(fraction.rlike(r"\d"), F.rpad(F.substring(fraction, 2, 6), 6, "0")).otherwise("0").cast("long")
    micros = F.unix_micros(day) + tiny - _seconds(offset).cast("long") * 1_000_000
    return F.when(valid & (_seconds(offset).between(-64800, 64800)), F.timestamp_micros(micros))


def normalise_date(raw: Column, retrieved_at: Column) -> Column:
    """Struct (instant, exact). Without an offset the time is taken as UTC and is not exact; a bare day starts at 00:00.

    More than an hour after retrieval the date is not believed and retrieval stands for it. What cannot be read is null.
    """
    x = cleaned(raw)
    iso = lambda i: F.regexp_extract(x, ISO, i)
    rfc = lambda i: F.regexp_extract(x, RFC, i)
    by_iso = _instant(iso(1), iso(2), iso(3), iso(4), iso(5), iso(6), iso(7), iso(8))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(rfc(3)))
    short = rfc(4).cast("int")
    year = F.when(F.length(rfc(4)) == 4, short).otherwise(F.when(short >= 70, 1900 + short).otherwise(2000 + short))
    local = F.try_make_timestamp(year, month.cast("int"), rfc(2).cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC"))
    right_day = (rfc(1) == "") | (F.lower(rfc(1)) == F.lower(F.date_format(local, "E")))
    by_rfc = F.when(right_day, _instant(year.cast("string"), month.cast("string"), rfc(2), rfc(5), rfc(6), rfc(7), F.lit(""), rfc(8)))
    found = F.when(x.rlike(ISO), by_iso).when(x.rlike(RFC), by_rfc)
    zoned = F.when(x.rlike(ISO), (iso(4) != "") & (iso(8) != "")).otherwise(rfc(8) != "")
    late = F.unix_micros(found) > F.unix_micros(retrieved_at) + SKEW * 1_000_000
    instant = F.when(late, retrieved_at).otherwise(found)
    return F.struct(instant.alias("instant"), F.coalesce(found.isNotNull() & zoned & ~late, F.lit(False)).alias("exact"))


def shown(instant: Column, zone: str, seconds: bool = False) -> Column:
    """An instant as a reader's clock shows it; null stays null. The session's zone is UTC."""
    from zoneinfo import ZoneInfo

    ZoneInfo(zone)  # an unknown zone is an error here, not in the executors
    return F.date_format(F.from_utc_timestamp(instant, zone), "dd.MM.yyyy HH:mm:ss" if seconds else "dd.MM.yyyy HH:mm")
