"""Running values of arrays and searches in sorted ones, as column expressions inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums(values: Column) -> Column:
    """[0, v0, v0 + v1, ...] of an array of longs. Elements take in what stands 1, 2, 4, ... places before them, so an array
    of n is passed over log2(n) times and no array grows step by step."""
    start = F.concat(F.array(F.lit(0).cast("long")), values)
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    add = lambda now, step: F.transform(now, lambda x, i: x + F.when(i >= step, F.get(now, i - step)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(steps, start, add)


def upto(sorted_values: Column, limit: Column) -> Column:
    """How many elements of an ascending array are at most ``limit``, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.size(sorted_values).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        open_ = s["low"] < s["high"]
        right = F.coalesce(F.get(sorted_values, middle) <= limit, F.lit(False))
        return F.struct(F.when(open_ & right, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(s["high"]).alias("high"))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_values) + 2)).cast("int"))
    return F.aggregate(halvings, start, halve, lambda s: s["low"])
