"""Dates, times and coordinates from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_datetime(text: Column) -> Column:
    """struct(day, second, precision) of a text: its first 14 digits wherever they stand.

    Fewer than 8 digits, or an invalid date: null. 14 digits with a valid time: precision 'second', else 'day' and second 0.
    """
    digits = F.substring(F.regexp_replace(text, r"[^0-9]", ""), 1, 14)
    day = F.when(F.length(digits) >= 8, F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))
    part = lambda i: F.substring(digits, i, 2).try_cast("int")
    timed = (F.length(digits) == 14) & (part(9) < 24) & (part(11) < 60) & (part(13) < 60)
    second = F.when(timed, part(9) * 3600 + part(11) * 60 + part(13)).otherwise(0)
    return F.when(day.isNotNull(), F.struct(day.alias("day"), second.alias("second"), F.when(timed, "second").otherwise("day").alias("precision")))


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC of a trailing Z or +hh:mm, -hh:mm; null without one."""
    sign = F.when(F.regexp_extract(text, r"([+-])\d\d:?\d\d$", 1) == "-", -1).otherwise(1)
    h, m = F.regexp_extract(text, r"[+-](\d\d):?(\d\d)$", 1).try_cast("int"), F.regexp_extract(text, r"[+-](\d\d):?(\d\d)$", 2).try_cast("int")
    return F.when(text.endswith("Z"), 0).when((h < 24) & (m < 60), sign * (h * 60 + m))


def utc_second(parsed: Column, offset: Column) -> Column:
    return F.unix_date(parsed["day"]).cast("long") * 86400 + parsed["second"] - F.coalesce(offset, F.lit(0)) * 60


def dms_to_decimal(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Signed decimal degrees; S and W are negative."""
    v = deg + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)
