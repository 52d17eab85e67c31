"""Evaluation over cases that stand for questions, runs and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import evaluation as ev


@query(
    "miss_causes",
    "SELECT o_custkey AS question, o_orderkey AS evidence, CASE WHEN o_orderkey % 6 = 0 THEN 'NOT_IN_CHUNKS' WHEN o_orderkey % 5 = 0 THEN 'OUT_OF_SCOPE' WHEN o_orderkey % 4 = 0 THEN 'RANKED_BELOW' ELSE 'NOT_RETRIEVED' END AS cause FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 7 = 0",
)
def miss_causes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("question"), i.alias("evidence"))
    e = F.col("evidence")
    chunk = (e * 10).alias("chunk")
    matching = wanted.filter(e % 6 > 0).select("evidence", chunk)
    admitted = wanted.filter(e % 5 > 0).select("question", chunk)
    hits = wanted.filter((e % 4 == 0) | (e % 7 > 0)).select("question", chunk, F.when(e % 4 == 0, 15).otherwise(3).alias("rank"))
    return ev.miss_causes(wanted, matching, admitted, hits, 10)


@query(
    "policy_frontier",
    "WITH g AS (SELECT o_orderpriority AS p, count(*) AS c, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS g FROM orders GROUP BY 1), r AS (SELECT sum(c) OVER w AS n, sum(g) OVER w AS s, sum(c) OVER () AS a, sum(g) OVER () AS whole FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT CAST(n AS BIGINT) AS n, round(n::DOUBLE / a, 6) AS rate, CAST(s AS DECIMAL(38,2)) AS gain_so_far, round(CAST(s AS DOUBLE) / CAST(whole AS DOUBLE), 6) AS retained, round(n::DOUBLE / a * CAST(whole AS DOUBLE), 2) AS expected FROM r",
)
def policy_frontier(spark: SparkSession, d: str) -> DataFrame:
    gains = table(spark, d, "orders").withColumn("gain", F.col("o_totalprice").cast("decimal(18,2)"))
    return ev.frontier(gains, "o_orderkey", "gain", [F.col("o_orderpriority")]).withColumn("gain_so_far", F.col("gain_so_far").cast("decimal(38,2)")).withColumn("expected", F.round("expected", 2))


@query("pass_consistency", "SELECT o_custkey, count(*) AS n_passes, count(DISTINCT o_orderstatus) = 1 AS same_ranking, round(max(o_totalprice) - min(o_totalprice), 6) AS drift, count(DISTINCT o_orderstatus) = 1 AND round(max(o_totalprice) - min(o_totalprice), 6) <= 100000 AS stable FROM orders GROUP BY 1")
def pass_consistency(spark: SparkSession, d: str) -> DataFrame:
    return ev.pass_consistency(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", 100_000)


@query(
    "family_left_out",
    "WITH n AS (SELECT l_orderkey AS c, l_returnflag AS label, l_extendedprice AS s FROM lineitem WHERE l_suppkey % 3 <> l_orderkey % 3), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s DESC, label) AS i FROM n QUALIFY i <= 3), v AS (SELECT c, label, count(*) AS votes, max(s) AS best FROM k GROUP BY ALL) SELECT c AS l_orderkey, label AS l_returnflag, votes, best FROM v QUALIFY row_number() OVER (PARTITION BY c ORDER BY votes DESC, best DESC, label) = 1",
)
def family_left_out(spark: SparkSession, d: str) -> DataFrame:
    near = table(spark, d, "lineitem").withColumn("family", F.col("l_orderkey") % 3).withColumn("other", F.col("l_suppkey") % 3)
    return ev.family_left_out(near, "l_orderkey", "family", "other", "l_returnflag", "l_extendedprice", 3)


@query("coverage_curve", "SELECT t::DOUBLE AS threshold, round(count(*) FILTER (value >= t)::DOUBLE / count(*), 6) AS coverage, round(count(*) FILTER (value >= t AND event_type = 'click')::DOUBLE / nullif(count(*) FILTER (value >= t), 0), 6) AS accuracy FROM events, (VALUES (0), (50), (100), (200), (400), (100000)) v(t) GROUP BY t")
def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return ev.coverage_curve(table(spark, d, "events").withColumn("ok", F.col("event_type") == "click"), "value", "ok", [0, 50, 100, 200, 400, 100_000])


@query(
    "case_verdicts",
    "WITH f AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS facts_found, count(*) AS facts_wanted FROM orders GROUP BY 1), c AS (SELECT user_id, count(*) AS cited, count(*) FILTER (event_type = 'error') AS foreign_cited FROM events GROUP BY 1) SELECT c_custkey AS k, coalesce(facts_found, 0) AS facts_found, coalesce(facts_wanted, 0) AS facts_wanted, coalesce(cited, 0) AS cited, coalesce(foreign_cited, 0) AS foreign_cited, CASE WHEN foreign_cited > 0 THEN 'FAIL' WHEN coalesce(facts_found, 0) = coalesce(facts_wanted, 0) THEN 'PASS' WHEN facts_found > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM customer LEFT JOIN f ON o_custkey = c_custkey LEFT JOIN c ON user_id = c_custkey",
)
def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") != "P").alias("ok"))
    citations = table(spark, d, "events").select(F.col("user_id").alias("k"), (F.col("event_type") == "error").alias("foreign"))
    return ev.verdicts(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), facts, citations, "k")


@query("routing_agreement", "SELECT 'route' AS \"column\", count(*) AS n, count(*) FILTER (o_orderkey % 7 > 0 AND o_orderkey % 5 > 0) AS agreed, round(count(*) FILTER (o_orderkey % 7 > 0 AND o_orderkey % 5 > 0)::DOUBLE / count(*), 6) AS rate FROM orders UNION ALL SELECT 'intent', count(*), count(*) FILTER (o_orderkey % 7 > 0), round(count(*) FILTER (o_orderkey % 7 > 0)::DOUBLE / count(*), 6) FROM orders")
def routing_agreement(spark: SparkSession, d: str) -> DataFrame:
    o, i = table(spark, d, "orders"), F.col("o_orderkey")
    expected = o.select("o_orderkey", F.col("o_orderpriority").alias("route"), F.lit(None).cast("string").alias("intent"))
    actual = o.filter(i % 7 > 0).select("o_orderkey", F.when(i % 5 > 0, F.col("o_orderpriority")).alias("route"), F.lit(None).cast("string").alias("intent"))
    return ev.agreement(expected, actual, "o_orderkey", ["route", "intent"])


@query("latest_attempts", "SELECT l_orderkey, l_linenumber, attempts, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS attempts, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1")
def latest_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("attempt", F.struct("l_linenumber", "l_suppkey"))
    return ev.latest_attempt(rows, "l_orderkey", "attempt").select("l_orderkey", "l_linenumber", "attempts", "l_suppkey")
