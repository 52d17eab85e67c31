"""Exact numbers out of text, percentages and tolerances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"


def printed_number(c: Column) -> Column:
    """A printed number with thousands separators and at most six decimals; anything else is null, nothing is rounded."""
    return F.when(c.rlike(r"^\s*-?(\d{1,3}(,\d{3})+|\d+)(\.\d{1,6})?\s*$"), F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast(MONEY))


def plain_decimal(c: Column) -> Column:
    return F.when(c.rlike(r"^-?\d{1,32}(\.\d{1,6})?$"), c.try_cast(MONEY))


def year(c: Column) -> Column:
    return F.when(c.rlike(r"^(19|20)\d{2}$"), c.try_cast("int"))


def percentage(part: Column, whole: Column) -> Column:
    """part of whole in percent, two places, half to even; null if whole is zero or null."""
    return F.bround(F.try_divide(part, whole) * 100, 2)


def progress(base: Column, now: Column, target: Column) -> Column:
    """Way from base to target in percent, two places, half up; null without distance."""
    return F.round(F.try_divide((now - base) * 100, target - base), 2)


def within(a: Column, b: Column, share: float = 0.005) -> Column:
    return F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
