"""Capture dates: wall-clock text and the seconds it would be in UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EXIF = r"^\s*(\d{4})[:\-/](\d{2})[:\-/](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
OFFSET = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"


def exif_to_iso(text: Column) -> Column:
    """`2020:06:05 14:03:22` as `2020-06-05T14:03:22`; null if a field is out of its range (days aren't counted by month)."""
    part = [F.regexp_extract(text, EXIF, k) for k in range(1, 7)]
    number = [F.expr("try_cast(null as int)") if p is None else p.try_cast("int") for p in part]
    fine = (number[0] >= 1900) & number[1].between(1, 12) & number[2].between(1, 31) & (number[3] <= 23) & (number[4] <= 59) & (number[5] <= 59)
    return F.when(text.rlike(EXIF) & fine, F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit("T"), part[3], F.lit(":"), part[4], F.lit(":"), part[5]))


def iso_local(text: Column) -> Column:
    """The wall clock of a date with an offset, which is dropped, not applied."""
    return F.when(text.rlike(OFFSET), F.concat_ws("T", F.regexp_extract(text, OFFSET, 1), F.regexp_extract(text, OFFSET, 2)))


def iso_to_ts(iso: Column) -> Column:
    """Seconds since 1970 as if the wall clock were UTC; null if there is no such date."""
    return F.unix_seconds(F.try_to_timestamp(F.concat(iso, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def mtime_to_iso(mtime_ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(mtime_ns / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss")


def same_mtime(a: Column, b: Column) -> Column:
    """Equal to the second."""
    return seconds(a) == seconds(b)


def seconds(ns: Column) -> Column:
    return F.floor(ns.cast("decimal(20,0)") / 1_000_000_000).cast("long")
