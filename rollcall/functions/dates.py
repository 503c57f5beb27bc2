"""Dates as ISO text, possibly partial, compared as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPEN_END = "9999-12-31"


def entity_date(time: Column) -> Column:
    """``+2020-01-15T00:00:00Z`` to ``2020-01-15``; years before our era keep their minus."""
    return F.substring_index(F.regexp_replace(time, r"^\+", ""), "T", 1)


def binding_date(text: Column) -> Column:
    """Query-service dates: the part before T, a year alone as its first day, else ten characters."""
    day = F.substring_index(text, "T", 1)
    return F.when(F.rlike(day, F.lit("^[0-9]{4}$")), F.concat(day, F.lit("-01-01"))).otherwise(F.substring(day, 1, 10))


def compact_date(text: Column) -> Column:
    """``YYYYMMDD`` or ``YYYYMM`` to ISO; anything else is null."""
    t = F.trim(text)
    full = F.regexp_replace(t, "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    part = F.regexp_replace(t, "^([0-9]{4})([0-9]{2})$", "$1-$2")
    return F.when(F.rlike(t, F.lit("^[0-9]{8}$")), full).when(F.rlike(t, F.lit("^[0-9]{6}$")), part)


def end_or_open(date: Column) -> Column:
    return F.coalesce(F.nullif(date, F.lit("")), F.lit(OPEN_END))


def overlaps(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Whether two periods with known starts share a day; an open end lasts for ever."""
    known = (F.coalesce(from_a, F.lit("")) != "") & (F.coalesce(from_b, F.lit("")) != "")
    return known & (from_a <= end_or_open(to_b)) & (from_b <= end_or_open(to_a))


def filled(old: Column, new: Column) -> Column:
    """``old`` unless it is null or empty."""
    return F.when(F.coalesce(old, F.lit("")) == "", new).otherwise(old)


def inverted(date: Column) -> Column:
    """Digits replaced by nine less the digit, so that later dates sort first and a prefix still sorts before."""
    return F.translate(F.coalesce(date, F.lit("")), "0123456789", "9876543210")
