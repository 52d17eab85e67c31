"""Aggregations, top-k, limits, sets and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.functions.numbers import percentage
from tallyforge.operators import aggregates, joins
from tallyforge.plans.common import REPORTS, reports

MONEY, TOTAL = "decimal(18,2)", "decimal(38,2)"


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_price, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_discount > 0.05) AS discounted
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast(MONEY)).cast(TOTAL).alias("sum_qty"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast(TOTAL).alias("sum_price"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query(
    "distinct_tuples",
    "SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_custkey",
)
def distinct_tuples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus", "o_orderpriority").alias("n"))


@query("argmax_ties", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS earliest FROM orders GROUP BY o_custkey")
def argmax_ties(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", key).alias("latest"), F.min_by("o_orderkey", key).alias("earliest"))


@query("joined_text", "SELECT l_orderkey, (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT l_returnflag || '/' || l_linestatus AS x FROM lineitem i WHERE i.l_orderkey = o.l_orderkey)) AS flags FROM (SELECT DISTINCT l_orderkey FROM lineitem) o")
def joined_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(aggregates.sorted_text(F.concat_ws("/", "l_returnflag", "l_linestatus")).alias("flags"))


@query(
    "strict_summary",
    """WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS a, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem),
s AS (SELECT l_orderkey, CASE WHEN count(a) = count(*) THEN sum(a) END AS total, sum(q) AS quantity FROM l GROUP BY l_orderkey)
SELECT l_orderkey, total, quantity, round_even(CAST(quantity * 100 AS DOUBLE) / CAST(total AS DOUBLE), 2) AS share FROM s""",
)
def strict_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice").cast(MONEY)).alias("a"), F.col("l_quantity").cast(MONEY).alias("q"))
    rows = rows.groupBy("l_orderkey").agg(aggregates.strict_sum(F.col("a")).cast(TOTAL).alias("total"), F.sum("q").cast(TOTAL).alias("quantity"))
    return rows.withColumn("share", F.bround((F.col("quantity") * 100).cast("double") / F.col("total").cast("double"), 2))


@query(
    "award_split",
    """SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS status, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'CONFLICT' ELSE 'AGREED' END AS verdict,
 max(CAST(l_extendedprice AS DECIMAL(18,2))) AS low_bound, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS high_bound, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey""",
)
def award_split(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice").cast(MONEY)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(aggregates.agreed(F.col("l_linestatus")).alias("status"), F.when(F.count_distinct("l_linestatus") > 1, "CONFLICT").otherwise("AGREED").alias("verdict"), F.max(price).alias("low_bound"), F.sum(price).cast(TOTAL).alias("high_bound"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(
    "primary_unique_max",
    "WITH s AS (SELECT l_suppkey, l_returnflag, CAST(floor(sum(l_quantity) / 100) AS BIGINT) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY score DESC) AS k FROM s) SELECT l_suppkey, CASE WHEN count(*) = 1 THEN max(l_returnflag) END AS l_returnflag FROM r WHERE k = 1 GROUP BY l_suppkey",
)
def primary_unique_max(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.floor(F.sum("l_quantity") / 100).alias("score"))
    return aggregates.unique_max(s, ["l_suppkey"], "score", "l_returnflag")


@query("first_seen_order", "WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS a FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(l_returnflag, '>' ORDER BY a, l_returnflag) AS flags FROM f GROUP BY l_orderkey")
def first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(aggregates.ordered_distinct(F.col("l_returnflag"), F.col("l_linenumber")), ">").alias("flags"))


@query(
    "dedup_counted",
    "SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS n, min(doc_id) AS first_id, max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS linked_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def dedup_counted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("linked_id")).filter("n > 1")


@query(
    "sequence_gaps",
    """WITH l AS (SELECT l_orderkey, CAST(CASE WHEN l_linenumber = 5 THEN 4 ELSE l_linenumber END AS BIGINT) AS k FROM lineitem WHERE l_linenumber <> 3), m AS (SELECT l_orderkey, max(k) AS top FROM l GROUP BY 1),
want AS (SELECT l_orderkey, unnest(range(1, top + 1)) AS k FROM m), miss AS (SELECT w.l_orderkey, string_agg(CAST(w.k AS VARCHAR), ',' ORDER BY w.k) AS t FROM want w ANTI JOIN l ON l.l_orderkey = w.l_orderkey AND l.k = w.k GROUP BY 1),
twice AS (SELECT l_orderkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS t FROM (SELECT l_orderkey, k FROM l GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
SELECT m.l_orderkey, coalesce(miss.t, '') AS missing, coalesce(twice.t, '') AS duplicated FROM m LEFT JOIN miss USING (l_orderkey) LEFT JOIN twice USING (l_orderkey)""",
)
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_linenumber <> 3").select("l_orderkey", F.when(F.col("l_linenumber") == 5, 4).otherwise(F.col("l_linenumber")).cast("long").alias("k"))
    return aggregates.gaps(rows, ["l_orderkey"], "k")


@query("violation_counts", "SELECT count(*) - count(DISTINCT o_orderkey) AS duplicate_ids, count(*) FILTER (o_totalprice < 0) AS negative, count(*) FILTER (o_orderdate IS NULL) AS undated, count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) AS foreign_status FROM orders")
def violation_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.agg((F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("duplicate_ids"), F.count_if(F.col("o_totalprice") < 0).alias("negative"), F.count_if(F.col("o_orderdate").isNull()).alias("undated"), F.count_if(~F.col("o_orderstatus").isin("O", "F", "P")).alias("foreign_status"))


@query("percentiles", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, median(value) AS median, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.median("value").alias("median"), F.round(F.avg("value"), 4).alias("mean"))


@query("confusion", "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).count()
    return out.select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


@query("conflicting_values", "SELECT l_partkey, l_suppkey, count(DISTINCT l_discount) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_discount) > 1")
def conflicting_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_discount").alias("n_values")).filter("n_values > 1")


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.profile(table(spark, d, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query(
    "table_fingerprint",
    """WITH o AS (SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders),
h AS (SELECT CAST('0x' || substr(sha256(concat_ws(chr(31), coalesce(CAST(o_orderkey AS VARCHAR), '␀'), coalesce(CAST(o_custkey AS VARCHAR), '␀'), coalesce(o_orderstatus, '␀'), coalesce(CAST(o_totalprice AS VARCHAR), '␀'), coalesce(CAST(o_orderdate AS VARCHAR), '␀'), coalesce(o_orderpriority, '␀'))), 1, 15) AS BIGINT) AS h FROM o)
SELECT count(*) AS n, bit_xor(h) AS "xor", CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total FROM h""",
)
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    return aggregates.fingerprint(o, o.columns).select("n", "xor", F.col("total").cast("string").alias("total"))


@query(
    "coverage_unknown",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NOT_COVERED' ELSE 'COVERED' END AS status, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def coverage_unknown(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "k")
    return docs.join(labels, docs["doc_id"] == labels["k"], "left").select("doc_id", F.when(F.col("k").isNull(), "NOT_COVERED").otherwise("COVERED").alias("status"), "toxic")


@query("top_k_per_group", "SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rank FROM documents QUALIFY rank <= 5")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 5")


@query("category_order", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def category_order(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(rank, F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(50)


@query("skyline", "SELECT a.p_partkey, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))")
def skyline(spark: SparkSession, d: str) -> DataFrame:
    return joins.skyline(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size"], ["p_retailprice"])


@query("union_of_ids", "SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events")
def union_of_ids(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"))
    return one("customer", "c_custkey").union(one("orders", "o_custkey")).union(one("events", "user_id")).distinct()


@query(
    "symmetric_difference",
    "(SELECT doc_id, 'documents' AS only_in FROM documents ANTI JOIN labels USING (doc_id)) UNION ALL (SELECT doc_id, 'labels' FROM labels ANTI JOIN documents USING (doc_id))",
)
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("only_in", F.lit("documents")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("only_in", F.lit("labels")))


@query("share_half_even", "SELECT o_custkey, round_even(CAST(count(*) FILTER (o_orderstatus = 'F') * 100 AS DOUBLE) / count(*), 2) AS share FROM orders GROUP BY o_custkey")
def share_half_even(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F").cast("double")
    return table(spark, d, "orders").groupBy("o_custkey").agg(percentage(done, F.count(F.lit(1))).alias("share"))


@query(
    "rolled_up",
    "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def rolled_up(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("long").alias("level"), F.count(F.lit(1)).alias("n"))
    return out.select("l_returnflag", "l_linestatus", "level", "n")


@query(
    "agreement_of_candidates",
    f"""WITH {REPORTS} SELECT entity, CASE WHEN count(DISTINCT rating) = 0 THEN 'MISSING' WHEN count(DISTINCT rating) = 1 THEN 'EXACT' ELSE 'CONFLICT' END AS status,
CASE WHEN count(DISTINCT rating) = 1 THEN min(rating) END AS rating FROM reports WHERE seq <= 2 GROUP BY entity""",
)
def agreement_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("rating")
    return reports(spark, d).filter("seq <= 2").groupBy("entity").agg(F.when(n == 0, "MISSING").when(n == 1, "EXACT").otherwise("CONFLICT").alias("status"), F.when(n == 1, F.min("rating")).alias("rating"))
