"""Stand-ins: the driver's tables read as entities, reports and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import table

#: Reports: an entity's orders in sequence, with a date, an ordinal rating (1 worst .. 5) and an amount.
REPORTS = """reports AS (
  SELECT o_orderkey AS record_id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq
  FROM orders)"""
#: Observations: an entity's values of one indicator in sequence.
OBSERVED = """observed AS (
  SELECT event_id AS record_id, user_id AS entity, event_type AS indicator, CAST(ts AS DATE) AS day,
         CAST(value AS DECIMAL(18,2)) AS value,
         CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS seq
  FROM events)"""


def reports(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("entity"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        nth.cast("long").alias("seq"),
    )


def observed(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("indicator"),
        F.col("ts").cast("date").alias("day"),
        F.col("value").cast("decimal(18,2)").alias("value"),
        nth.cast("long").alias("seq"),
    )
