"""Operators over ordered series of rows; an entity's series is ordered by sequence, never by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by ``order``; Spark limits groups before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", nth).filter(F.col("__n") <= n).drop("__n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def runs_where(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Gaps and islands: one row (keys, first, last, n) for each run of consecutive rows where ``flag`` is true.
    A null flag breaks a run like false does."""
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    by_key, by_flag = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, "__f").orderBy(order)
    rows = rows.withColumn("__island", F.row_number().over(by_key) - F.row_number().over(by_flag)).filter("__f")
    return rows.groupBy(*keys, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__island")


def runs_of_equal(df: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """One row (keys, value, first, last, n) for each run of consecutive equal values, null equalling null."""
    by_key = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("value", value)
    rows = rows.withColumn("__start", (F.row_number().over(by_key) == 1) | ~F.col("value").eqNullSafe(F.lag("value").over(by_key)))
    rows = rows.withColumn("__run", F.sum(F.col("__start").cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "__run").agg(F.first("value").alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def suffix_min(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The least value from each row to its series' end."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.min(value).over(w))


def changes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the last one known before them, with it as ``previous``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("previous", F.last(value, ignorenulls=True).over(w))
    return rows.filter(F.col(value).isNotNull() & F.col("previous").isNotNull() & (F.col(value) != F.col("previous")))


def interleaved(df: DataFrame, call: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Round-robin over calls: first rows of all calls, then second ones, until ``size`` sums to the budget.

    Rounds are summed first; only those inside the budget, and of the one that crosses it as many rows as could fit, are
    numbered. So what is sorted follows the budget, not the table (rows of no size aside).
    """
    rows = numbered(df, [call], order, "round")
    rounds = rows.groupBy("round").agg(F.sum(size).alias("__s"))
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each round
    rounds = rounds.withColumn("__upto", F.sum("__s").over(upto)).filter(F.col("__upto") - F.col("__s") <= budget)
    near = rows.join(rounds, "round")
    empty = near.filter((F.col("__upto") > budget) & (F.col(size) <= 0)).count()
    last = near.filter(F.col("__upto") > budget).orderBy("round", call).limit(budget + 1 + empty)
    held = near.filter(F.col("__upto") <= budget).unionByName(last)
    inside = Window.partitionBy("round").orderBy(call).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("used", F.sum(size).over(inside) + F.col("__upto") - F.col("__s"))
    return held.filter(F.col("used") <= budget).drop("__s", "__upto")
