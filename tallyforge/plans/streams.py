"""The streaming operators over the events table as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.streaming import windows


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(_events(spark, d), "ts", ["event_type"], "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(_events(spark, d), "ts", ["user_id"], "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))
