"""Series of reports and observations: latest, previous, runs, changes, order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import windows
from tallyforge.plans.common import OBSERVED, REPORTS, observed, reports


@query("latest_report", f"WITH {REPORTS} SELECT entity, record_id, seq, rating FROM reports QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq DESC) = 1")
def latest_report(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest(reports(spark, d), ["entity"], [F.col("seq").desc()]).select("entity", "record_id", "seq", "rating")


@query(
    "latest_and_previous",
    f"""WITH {REPORTS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS k FROM reports)
SELECT entity, max(CASE WHEN k = 1 THEN rating END) AS now, max(CASE WHEN k = 2 THEN rating END) AS before FROM n WHERE k <= 2 GROUP BY entity""",
)
def latest_and_previous(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.numbered(reports(spark, d), ["entity"], [F.col("seq").desc()], "k").filter("k <= 2")
    return rows.groupBy("entity").agg(F.max(F.when(F.col("k") == 1, F.col("rating"))).alias("now"), F.max(F.when(F.col("k") == 2, F.col("rating"))).alias("before"))


@query("latest_observation", f"WITH {OBSERVED} SELECT entity, indicator, record_id, value FROM observed QUALIFY row_number() OVER (PARTITION BY entity, indicator ORDER BY seq DESC) = 1")
def latest_observation(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest(observed(spark, d), ["entity", "indicator"], [F.col("seq").desc()]).select("entity", "indicator", "record_id", "value")


@query(
    "result_progress",
    f"""WITH {OBSERVED}, l AS (SELECT *, lag(value) OVER w AS previous, lag(record_id) OVER w AS previous_id, lag(day) OVER w AS previous_day,
  first_value(value) OVER w AS base, max(value) OVER (PARTITION BY entity, indicator) AS target FROM observed WINDOW w AS (PARTITION BY entity, indicator ORDER BY seq))
SELECT record_id, entity, indicator, seq, previous_id, value - previous AS absolute_change, datediff('day', previous_day, day) AS days,
  CAST(sign(value - previous) AS INTEGER) AS direction,
  CASE WHEN target = base THEN NULL ELSE round(CAST((value - base) * 100 AS DOUBLE) / CAST(target - base AS DOUBLE), 2) END AS progress,
  CASE WHEN previous IS NULL THEN 'FIRST' WHEN value = previous THEN 'FLAT' WHEN abs(target - value) < abs(target - previous) THEN 'TOWARD' ELSE 'AWAY' END AS trend,
  CASE WHEN target = base THEN 'ZERO_DISTANCE' WHEN value = target THEN 'MET' WHEN value > base THEN 'PARTIAL' ELSE 'NOT_MET' END AS target_status
FROM l""",
)
def result_progress(spark: SparkSession, d: str) -> DataFrame:
    key = Window.partitionBy("entity", "indicator")
    w = key.orderBy("seq")
    rows = observed(spark, d)
    rows = rows.select("*", F.lag("value").over(w).alias("previous"), F.lag("record_id").over(w).alias("previous_id"), F.lag("day").over(w).alias("previous_day"), F.first("value").over(w).alias("base"), F.max("value").over(key).alias("target"))
    v, p, b, t = (F.col(c) for c in ("value", "previous", "base", "target"))
    return rows.select(
        "record_id",
        "entity",
        "indicator",
        "seq",
        "previous_id",
        (v - p).alias("absolute_change"),
        F.datediff("day", "previous_day").cast("long").alias("days"),
        F.signum(v - p).cast("int").alias("direction"),
        F.when(t != b, F.round(((v - b) * 100).cast("double") / (t - b).cast("double"), 2)).alias("progress"),
        F.when(p.isNull(), "FIRST").when(v == p, "FLAT").when(F.abs(t - v) < F.abs(t - p), "TOWARD").otherwise("AWAY").alias("trend"),
        F.when(t == b, "ZERO_DISTANCE").when(v == t, "MET").when(v > b, "PARTIAL").otherwise("NOT_MET").alias("target_status"),
    )


@query(
    "rating_runs",
    f"""WITH {REPORTS}, f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) - row_number() OVER (PARTITION BY entity, rating <= 3 ORDER BY seq) AS g FROM reports)
SELECT entity, min(seq) AS first, max(seq) AS last, count(*) AS n FROM f WHERE rating <= 3 GROUP BY entity, g""",
)
def rating_runs(spark: SparkSession, d: str) -> DataFrame:
    return windows.runs_where(reports(spark, d), ["entity"], "seq", F.col("rating") <= 3)


@query(
    "flat_runs",
    f"""WITH {OBSERVED}, s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR floor(value / 50) IS DISTINCT FROM lag(floor(value / 50)) OVER w THEN 1 ELSE 0 END AS st FROM observed WINDOW w AS (PARTITION BY entity, indicator ORDER BY seq)),
g AS (SELECT *, sum(st) OVER (PARTITION BY entity, indicator ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT entity, indicator, CAST(min(floor(value / 50)) AS BIGINT) AS value, min(seq) AS first, max(seq) AS last, count(*) AS n FROM g GROUP BY entity, indicator, run""",
)
def flat_runs(spark: SparkSession, d: str) -> DataFrame:
    return windows.runs_of_equal(observed(spark, d), ["entity", "indicator"], "seq", F.floor(F.col("value") / 50).cast("long"))


@query(
    "date_regressions",
    f"""WITH {REPORTS}, b AS (SELECT entity, seq, day + CAST(record_id % 40 AS INTEGER) AS day FROM reports),
m AS (SELECT *, min(day) OVER (PARTITION BY entity ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS least, lead(day) OVER (PARTITION BY entity ORDER BY seq) AS next_day FROM b)
SELECT entity, seq, day, least, coalesce(next_day < day, false) AS regressed FROM m WHERE least < day""",
)
def date_regressions(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d).select("entity", "seq", F.date_add("day", (F.col("record_id") % 40).cast("int")).alias("day"))
    rows = windows.suffix_min(rows, ["entity"], "seq", "day", "least")
    rows = rows.withColumn("next_day", F.lead("day").over(Window.partitionBy("entity").orderBy("seq")))
    return rows.filter("least < day").select("entity", "seq", "day", "least", F.coalesce(F.col("next_day") < F.col("day"), F.lit(False)).alias("regressed"))


@query(
    "state_changes",
    f"""WITH {REPORTS}, b AS (SELECT entity, seq, CASE WHEN record_id % 5 = 0 THEN NULL ELSE rating END AS state FROM reports),
p AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM b)
SELECT entity, seq, state, previous FROM p WHERE state <> previous""",
)
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d).select("entity", "seq", F.when(F.col("record_id") % 5 != 0, F.col("rating")).alias("state"))
    return windows.changes(rows, ["entity"], "seq", "state").select("entity", "seq", "state", "previous")


@query(
    "timeline",
    """WITH u AS (
  SELECT o_custkey AS entity, 'ORDERED' AS kind, CAST(o_orderdate AS DATE) AS day, o_orderkey AS source_id, CAST(0 AS BIGINT) AS line FROM orders
  UNION ALL SELECT o_custkey, 'SHIPPED', CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END, l_orderkey, CAST(l_linenumber AS BIGINT) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT user_id, upper(event_type), CAST(ts AS DATE), event_id, CAST(0 AS BIGINT) FROM events)
SELECT entity, kind, day, source_id, line, row_number() OVER (PARTITION BY entity ORDER BY day NULLS LAST, kind, source_id, line) AS event_sequence FROM u""",
)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    orders, lines, events = (table(spark, d, t) for t in ("orders", "lineitem", "events"))
    shipped = F.when(F.col("l_linenumber") != 7, F.col("l_shipdate").cast("date"))
    zero = F.lit(0).cast("long").alias("line")
    out = orders.select(F.col("o_custkey").alias("entity"), F.lit("ORDERED").alias("kind"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("source_id"), zero)
    out = out.unionByName(lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("entity"), F.lit("SHIPPED").alias("kind"), shipped.alias("day"), F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").cast("long").alias("line")))
    out = out.unionByName(events.select(F.col("user_id").alias("entity"), F.upper("event_type").alias("kind"), F.col("ts").cast("date").alias("day"), F.col("event_id").alias("source_id"), zero))
    return windows.numbered(out, ["entity"], [F.col("day").asc_nulls_last(), F.col("kind"), F.col("source_id"), F.col("line")], "event_sequence")


@query(
    "rating_history_range",
    f"""WITH {REPORTS}, l AS (SELECT entity, seq, rating, lag(rating) OVER (PARTITION BY entity ORDER BY seq) AS previous, seq - lag(seq) OVER (PARTITION BY entity ORDER BY seq) AS step FROM reports)
SELECT entity, seq, rating, previous, CASE WHEN previous IS NULL THEN 'NOT_COMPARABLE' WHEN rating > previous THEN 'UPGRADE' WHEN rating < previous THEN 'DOWNGRADE' ELSE 'UNCHANGED' END AS change, coalesce(step > 1, false) AS after_gap
FROM l WHERE seq BETWEEN 3 AND 8""",
)
def rating_history_range(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("seq")
    rows = reports(spark, d).select("entity", "seq", "rating", F.lag("rating").over(w).alias("previous"), (F.col("seq") - F.lag("seq").over(w)).alias("step"))
    r, p = F.col("rating"), F.col("previous")
    change = F.when(p.isNull(), "NOT_COMPARABLE").when(r > p, "UPGRADE").when(r < p, "DOWNGRADE").otherwise("UNCHANGED")
    return rows.filter("seq between 3 and 8").select("entity", "seq", "rating", "previous", change.alias("change"), F.coalesce(F.col("step") > 1, F.lit(False)).alias("after_gap"))


@query(
    "packed_calls",
    """WITH n AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM conversations),
u AS (SELECT *, CAST(sum(size) OVER (ORDER BY round, conv_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM n)
SELECT conv_id, turn, CAST(size AS BIGINT) AS size, CAST(round AS BIGINT) AS round, used FROM u WHERE used <= 50000""",
)
def packed_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return windows.interleaved(rows, "conv_id", [F.col("turn")], "size", 50_000)
