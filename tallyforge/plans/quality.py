"""Invariants and observations as one union of counts, and rule groups that make issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.functions.text import collapse


def counted(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_id, n): all checks in one action instead of a job for each."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_id"), "n") for name, df in checks.items()))


_CHECKS = {
    "ORDER_ORPHANS": "SELECT 1 FROM orders ANTI JOIN customer ON c_custkey = o_custkey",
    "LINE_ORPHANS": "SELECT 1 FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey",
    "DUPLICATE_ORDERS": "SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1",
    "DUPLICATE_LINES": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "NEGATIVE_PRICE": "SELECT 1 FROM lineitem WHERE l_extendedprice < 0 OR l_quantity <= 0",
    "DATE_ORDER": "SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate",
    "FOREIGN_VOCABULARY": "SELECT 1 FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')",
    "BLANK_TEXT": "SELECT 1 FROM documents WHERE text IS NULL OR trim(text) = ''",
    "SIZE_DRIFT": "SELECT 1 FROM documents WHERE length(text) <> n_chars",
    "IDENTICAL_CONTENT": "SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1",
    "LABEL_WITHOUT_DOCUMENT": "SELECT 1 FROM labels ANTI JOIN documents USING (doc_id)",
    "PREDICTIVE_WORDING": "SELECT 1 FROM documents WHERE regexp_matches(lower(text), '\\b(will|forecast|predict)\\w*')",
}


@query("quality_checks", " UNION ALL ".join(f"SELECT '{k}' AS check_id, (SELECT count(*) FROM ({v})) AS n" for k, v in _CHECKS.items()))
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    c, o, l, docs, labels = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "documents", "labels"))  # noqa: E741
    on_order = F.col("l_orderkey") == F.col("o_orderkey")
    return counted(
        {
            "ORDER_ORPHANS": o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
            "LINE_ORPHANS": l.join(o, on_order, "left_anti"),
            "DUPLICATE_ORDERS": o.groupBy("o_orderkey").count().filter("count > 1"),
            "DUPLICATE_LINES": l.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"),
            "NEGATIVE_PRICE": l.filter("l_extendedprice < 0 or l_quantity <= 0"),
            "DATE_ORDER": l.join(o, on_order).filter("l_shipdate < o_orderdate"),
            "FOREIGN_VOCABULARY": o.filter(~F.col("o_orderstatus").isin("O", "F", "P")),
            "BLANK_TEXT": docs.filter("text is null or trim(text) = ''"),
            "SIZE_DRIFT": docs.filter("length(text) <> n_chars"),
            "IDENTICAL_CONTENT": docs.groupBy(F.sha2("text", 256)).count().filter("count > 1"),
            "LABEL_WITHOUT_DOCUMENT": labels.join(docs, "doc_id", "left_anti"),
            "PREDICTIVE_WORDING": docs.filter(F.lower("text").rlike(r"\b(will|forecast|predict)\w*")),
        }
    )


@query(
    "blank_fields",
    "SELECT doc_id, field, 'REQUIRED_BLANK' AS issue FROM (SELECT doc_id, 'lang' AS field, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS v FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 13 = 0 THEN NULL ELSE source END FROM documents) WHERE v IS NULL OR trim(v) = ''",
)
def blank_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("source"))
    rows = docs.unpivot("doc_id", ["lang", "source"], "field", "v")
    return rows.filter(collapse(F.col("v")).isNull()).select("doc_id", "field", F.lit("REQUIRED_BLANK").alias("issue"))


@query("presence_and_duplicates", "WITH e AS (SELECT unnest(range(0, 40)) AS nation), c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT nation, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'SEVERAL' ELSE 'ONE' END AS status FROM e LEFT JOIN c ON s_nationkey = nation")
def presence_and_duplicates(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = spark.range(40).withColumnRenamed("id", "nation").join(counts, F.col("s_nationkey") == F.col("nation"), "left")
    return rows.select("nation", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "SEVERAL").otherwise("ONE").alias("status"))


@query(
    "issues_exploded",
    "WITH i AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'LARGE' END, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'UNRANKED' END], lambda x: x IS NOT NULL)) AS issue FROM orders) SELECT issue, count(*) AS n, min(o_orderkey) AS first_id FROM i GROUP BY issue",
)
def issues_exploded(spark: SparkSession, d: str) -> DataFrame:
    issues = F.array_compact(F.array(F.when(F.col("o_totalprice") > 300000, "LARGE"), F.when(F.col("o_orderstatus") == "P", "PENDING"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "UNRANKED")))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(issues).alias("issue"))
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))


@query("modal_size", "WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT n AS modal FROM s GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) SELECT l_orderkey, n, modal FROM s, m WHERE n < modal")
def modal_size(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    modal = s.groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(1).select(F.col("n").alias("modal"))
    return s.crossJoin(F.broadcast(modal)).filter("n < modal")  # one row


@query("unmatched_severity", "SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) AS severity, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS place FROM orders GROUP BY o_custkey")
def unmatched_severity(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(rank).alias("severity"), F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct count
    places = rows.groupBy("n").agg(F.count(F.lit(1)).alias("k")).select("n", (F.coalesce(F.sum("k").over(above), F.lit(0)) + 1).cast("long").alias("place"))
    return rows.join(places, "n").select("o_custkey", "severity", "n", "place")
