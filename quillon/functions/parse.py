"""Lenient parsers of export fields: what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_stars(text: Column) -> Column:
    """Half stars 1..10 of a rating 0.5..5, rounded half to even; null out of bounds."""
    value = F.expr("try_cast(null as double)") if text is None else F.try_to_number(F.trim(text), F.lit("999.999")).cast("double")
    halves = F.bround(value * 2, 0).cast("int")
    return F.when(halves.between(1, 10), halves)


def day(text: Column) -> Column:
    """The date at the beginning of a text; null for a month or day that doesn't exist."""
    return F.try_to_date(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def year(text: Column, least: int = 1870, most: int = 2100) -> Column:
    found = F.regexp_extract(text, r"^\s*(\d{4})\s*$", 1)
    value = F.when(found != "", found).cast("int")
    return F.when(value.between(least, most), value)


def id_in_uri(uri: Column) -> Column:
    found = F.regexp_extract(uri, r"/(\d+)(?:[-/?#]|$)", 1)
    return F.when(found != "", found).cast("long")
