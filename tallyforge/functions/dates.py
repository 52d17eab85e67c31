"""Dates out of text and between dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST, LATEST = "1944-07-01", "2100-12-31"


def first_date(c: Column, formats: tuple[str, ...]) -> Column:
    """The date by the first format that fits; null if none does."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats))


def day_or_month_end(c: Column) -> Column:
    """``05-Jan-2020``, or the last day of ``Jan/2020``."""
    return F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("d-MMM-yyyy"))), F.last_day(F.to_date(F.try_to_timestamp(c, F.lit("MMM/yyyy")))))


def plausible(c: Column) -> Column:
    return c.between(F.lit(EARLIEST).cast("date"), F.lit(LATEST).cast("date"))


def elapsed_share(start: Column, now: Column, end: Column) -> Column:
    """Share of an interval that has passed, in percent with two places."""
    d = lambda a, b: F.datediff(a, b).cast("decimal(38,6)")
    return F.round(F.try_divide(d(now, start) * 100, d(end, start)), 2)
