"""Aggregates whose nulls, ties and order are defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_sum(c: Column) -> Column:
    """Null if any input is null or there is none: a sum of unknowns is unknown."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(c) == F.count(F.lit(1))), F.sum(c))


def agreed(c: Column) -> Column:
    """The value that all rows have, null counting as one; null where they differ."""
    return F.when((F.count_distinct(c) + F.max(c.isNull().cast("int"))) == 1, F.max(c))


def ordered_distinct(value: Column, order: Column) -> Column:
    """Distinct values in the order of their first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))


def sorted_text(c: Column, separator: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def unique_max(df: DataFrame, keys: list[str], score: str, value: str) -> DataFrame:
    """(keys, value) of the row with the greatest score; null if several tie for it."""
    ranked = df.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last()))).filter("__r = 1")
    return ranked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).alias(value))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, xor, total): an order-insensitive print of a table that needs no sorting and no gathering, of 60 bits of
    each row's SHA-256. Columns are joined by a control character, nulls are a symbol of their own."""
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u2400")) for c in columns))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column (column, n, n_null, n_distinct), all in one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"c_{c}") for c in columns), *(F.count_distinct(c).alias(f"d_{c}") for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n"), (F.col("n") - F.col(f"c_{c}")).alias("n_null"), F.col(f"d_{c}").alias("n_distinct")) for c in columns))
    return one.select(F.inline(rows))


def gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, missing, duplicated): which of 1..max a key lacks or has twice, as joined text."""
    per = df.groupBy(*keys, number).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys)
    per = per.agg(F.collect_set(number).alias("__all"), F.array_sort(F.collect_list(F.when(F.col("__n") > 1, F.col(number)))).alias("__twice"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1).cast("long"), F.array_max("__all").cast("long")), "__all"))
    return per.select(*keys, F.array_join(missing, ",").alias("missing"), F.array_join("__twice", ",").alias("duplicated"))
