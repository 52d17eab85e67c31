"""Joins: equi, outer, anti, semi, as-of, tolerance, either key, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import joins
from tallyforge.plans.common import REPORTS, reports


@query("star_chain", "SELECT l_orderkey, l_linenumber, c_name, n_name, r_name, s_name, p_brand FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey")
def star_chain(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    out = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    out = out.join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name", "s_name", "p_brand")


@query("orphans_both_ways", "SELECT 'customer_without_order' AS kind, c_custkey AS id FROM customer ANTI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'order_without_customer', o_orderkey FROM orders ANTI JOIN customer ON o_custkey = c_custkey")
def orphans_both_ways(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = F.col("o_custkey") == F.col("c_custkey")
    return c.join(o, on, "left_anti").select(F.lit("customer_without_order").alias("kind"), F.col("c_custkey").alias("id")).union(o.join(c, on, "left_anti").select(F.lit("order_without_customer"), "o_orderkey"))


@query("composite_anti", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part, supplier WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND s_suppkey % 3 = p_partkey % 3)")
def composite_anti(spark: SparkSession, d: str) -> DataFrame:
    l, p, s = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))  # noqa: E741
    pairs = l.select("l_partkey", "l_suppkey").distinct().filter("l_suppkey % 3 = l_partkey % 3")
    known = pairs.join(p, F.col("p_partkey") == F.col("l_partkey"), "left_semi").join(s, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    return l.join(known, ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_partkey", "l_suppkey")


@query("semi_in_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AND o_orderstatus IN ('O', 'P')")
def semi_in_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("inequality_filter", "SELECT o_orderkey, count(*) AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) > CAST(o_orderdate + INTERVAL 2 MONTH AS DATE) GROUP BY o_orderkey")
def inequality_filter(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    rows = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("l_shipdate").cast("date") > F.add_months(F.col("o_orderdate").cast("date"), 2))
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("late"))


@query(
    "either_key_join",
    "WITH c AS (SELECT p_partkey AS id, (p_partkey * 7) % 100 + 1 AS key_a, (p_partkey * 13) % 100 + 1 AS key_b FROM part) SELECT c.id, s.s_suppkey FROM c JOIN supplier s ON s.s_suppkey IN (c.key_a, c.key_b)",
)
def either_key_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7) % 100 + 1).alias("key_a"), ((F.col("p_partkey") * 13) % 100 + 1).alias("key_b"))
    return joins.either_key(c, ("key_a", "key_b"), table(spark, d, "supplier"), "s_suppkey").select("id", "s_suppkey")


@query(
    "next_event",
    "SELECT o_orderkey, o_custkey, (SELECT min(ts) FROM events WHERE user_id = o_custkey AND ts >= o_orderdate) AS next_at FROM orders",
)
def next_event(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    e = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"), "ts")
    return joins.next_match(o, e, ["o_custkey"], "o_orderdate", "ts", "next_at").select("o_orderkey", "o_custkey", "next_at")


_LINK_SQL = "CAST({0}_nationkey * 1000 + floor({0}_acctbal / 500) AS BIGINT)"


@query(
    "unique_link",
    f"WITH r AS (SELECT {_LINK_SQL.format('c')} AS k, min(c_custkey) AS t, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_suppkey, {_LINK_SQL.format('s')} AS k FROM supplier) SELECT s_suppkey, CASE WHEN n IS NULL THEN 'NO_MATCH' WHEN n = 1 THEN 'LINKED' ELSE 'AMBIGUOUS' END AS link_status, CASE WHEN n = 1 THEN t END AS c_custkey FROM s LEFT JOIN r USING (k)",
)
def unique_link(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers linked to the only customer of their nation and balance band."""
    key = lambda x: (F.col(f"{x}_nationkey") * 1000 + F.floor(F.col(f"{x}_acctbal") / 500)).cast("long").alias("k")
    s = table(spark, d, "supplier").select("s_suppkey", key("s"))
    c = table(spark, d, "customer").select(key("c"), "c_custkey")
    return joins.unique_link(s, c, "k", "c_custkey").drop("k")


@query(
    "amount_tolerance",
    "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 50",
)
def amount_tolerance(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), "s_acctbal")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal")
    return joins.near_amount(s, c, "k", "s_acctbal", "c_acctbal", 50.0).select("s_suppkey", "c_custkey")


@query(
    "compared_sources",
    """WITH a AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, count(*) AS lines FROM lineitem GROUP BY 1), p AS (
SELECT o_orderkey, 'amount' AS field, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS x, CAST(price AS DECIMAL(38,2)) AS y FROM orders LEFT JOIN a ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, 'lines', CAST(o_custkey % 7 + 1 AS DECIMAL(38,2)), CAST(lines AS DECIMAL(38,2)) FROM orders LEFT JOIN a ON l_orderkey = o_orderkey)
SELECT o_orderkey, field, CASE WHEN x IS NULL OR y IS NULL THEN 'NOT_COMPARABLE' WHEN x = y THEN 'AGREE' ELSE 'DIFFER' END AS verdict FROM p""",
)
def compared_sources(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"), F.count(F.lit(1)).alias("lines"))
    rows = table(spark, d, "orders").join(a, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = rows.selectExpr("o_orderkey", "stack(2, 'amount', cast(cast(o_totalprice as decimal(18,2)) as decimal(38,2)), cast(price as decimal(38,2)), 'lines', cast(o_custkey % 7 + 1 as decimal(38,2)), cast(lines as decimal(38,2))) as (field, x, y)")
    return rows.select("o_orderkey", "field", F.when(F.col("x").isNull() | F.col("y").isNull(), "NOT_COMPARABLE").when(F.col("x") == F.col("y"), "AGREE").otherwise("DIFFER").alias("verdict"))


@query(
    "blocked_pairs",
    "SELECT a.p_brand, a.p_type, a.p_partkey AS key_a, b.p_partkey AS key_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey",
)
def blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.blocked_pairs(table(spark, d, "part"), ["p_brand", "p_type"], "p_partkey")


@query("evidence_contained", "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def evidence_contained(spark: SparkSession, d: str) -> DataFrame:
    """Documents that quote a benchmark item: the item's first 5-word run is looked up before the text is searched."""
    from tallyforge.operators.retrieval import quoting

    return quoting(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")


@query("provenance_chain", "WITH u AS (SELECT doc_id, 'label' AS kind, CAST(quality AS BIGINT) AS value FROM labels UNION ALL SELECT doc_id, 'size', n_chars FROM documents) SELECT d.doc_id, d.source, u.kind, u.value FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id AND u.value > 0")
def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    u = table(spark, d, "labels").select(F.col("doc_id").alias("k"), F.lit("label").alias("kind"), F.col("quality").cast("long").alias("value")).union(docs.select("doc_id", F.lit("size"), "n_chars"))
    return docs.join(u.filter("value > 0"), F.col("doc_id") == F.col("k"), "left").select("doc_id", "source", "kind", "value")


@query("scalar_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS unlabelled")
def scalar_counts(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return one(docs, "documents").crossJoin(one(labels, "labels")).crossJoin(one(docs.join(labels, "doc_id", "left_anti"), "unlabelled"))


@query(
    "before_after_anchor",
    f"WITH {REPORTS}, a AS (SELECT day AS anchor FROM reports ORDER BY amount DESC, record_id LIMIT 1) SELECT record_id, CASE WHEN day < anchor THEN 'BEFORE' WHEN day > anchor THEN 'AFTER' ELSE 'AT' END AS relation FROM reports, a",
)
def before_after_anchor(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d)
    anchor = rows.orderBy(F.col("amount").desc(), "record_id").limit(1).select(F.col("day").alias("anchor"))
    relation = F.when(F.col("day") < F.col("anchor"), "BEFORE").when(F.col("day") > F.col("anchor"), "AFTER").otherwise("AT")
    return rows.crossJoin(F.broadcast(anchor)).select("record_id", relation.alias("relation"))  # one row


@query(
    "manifest_reconciled",
    """WITH m AS (SELECT doc_id, quality FROM labels), i AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS quality FROM documents)
SELECT coalesce(m.doc_id, i.doc_id) AS doc_id, CASE WHEN m.doc_id IS NULL THEN 'DOCUMENT_ONLY' WHEN i.doc_id IS NULL THEN 'MANIFEST_ONLY' WHEN m.quality = i.quality THEN 'CONFIRMED' ELSE 'CONFLICT' END AS status FROM m FULL JOIN i ON m.doc_id = i.doc_id""",
)
def manifest_reconciled(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "labels").select(F.col("doc_id").alias("m"), F.col("quality").alias("mq"))
    i = table(spark, d, "documents").select(F.col("doc_id").alias("i"), (F.col("n_chars") > 1500).cast("int").alias("iq"))
    status = F.when(F.col("m").isNull(), "DOCUMENT_ONLY").when(F.col("i").isNull(), "MANIFEST_ONLY").when(F.col("mq") == F.col("iq"), "CONFIRMED").otherwise("CONFLICT")
    return m.join(i, F.col("m") == F.col("i"), "full").select(F.coalesce("m", "i").alias("doc_id"), status.alias("status"))


_WORDS = "list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size % 5), '([\\p{L}\\p{N}]+)')))"


@query(
    "similar_names",
    f"""WITH s AS (SELECT p_brand, {_WORDS} AS w, min(p_partkey) AS k FROM part GROUP BY ALL),
j AS (SELECT a.p_brand, a.k AS key_a, b.k AS key_b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS size_a, len(b.w) AS size_b FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.k < b.k)
SELECT p_brand, key_a, key_b, shared, size_a, size_b, round(shared::DOUBLE / (size_a + size_b - shared), 6) AS similarity FROM j WHERE shared >= 0.7 * (size_a + size_b - shared)""",
)
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of a brand's parts that share at least 0.7 of their words."""
    from tallyforge.operators import similarity

    name = F.concat_ws(" ", "p_name", "p_type", "p_brand", (F.col("p_size") % 5).cast("string"))
    found = similarity.similar(table(spark, d, "part").withColumn("name", name), ["p_brand"], "p_partkey", "name", 0.7)
    return found.select("p_brand", "key_a", "key_b", *(F.col(c).cast("long").alias(c) for c in ("shared", "size_a", "size_b")), "similarity")


_PRINTED = "p_name || CASE WHEN p_partkey % 5 = 0 THEN ' - ' ELSE ', ' END || p_type || CASE WHEN p_partkey % 7 = 0 THEN ' of size ' || p_size ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' (Number, Custom)' ELSE '' END"


@query(
    "name_matches",
    f"""WITH n AS (SELECT p_brand, p_partkey AS k, trim(regexp_replace(lower(regexp_replace({_PRINTED}, '(?:\s*\([^()]*\))+\s*$', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS base FROM part)
SELECT a.p_brand, a.k AS key_a, b.k AS key_b, CASE WHEN a.base = b.base THEN 'SAME_BASE' ELSE 'PREFIX' END AS reason FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.k < b.k
WHERE a.base = b.base OR (least(length(a.base), length(b.base)) >= 12 AND (starts_with(a.base, b.base) OR starts_with(b.base, a.base)))""",
)
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Printed names of a brand's parts that are equal but for units and punctuation, or of which one begins the other."""
    from tallyforge.operators import similarity

    key = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.when(key % 5 == 0, " - ").otherwise(", "), F.col("p_type"), F.when(key % 7 == 0, F.concat(F.lit(" of size "), F.col("p_size").cast("string"))).otherwise(""), F.when(key % 3 == 0, " (Number, Custom)").otherwise(""))
    return similarity.possible_matches(table(spark, d, "part").withColumn("name", name), ["p_brand"], "p_partkey", "name", 12)


@query(
    "phrase_hits",
    "SELECT doc_id, item_id, instr(d.text, b.text) AS start, substr(d.text, greatest(1, instr(d.text, b.text) - 40), length(b.text) + 40 + least(40, instr(d.text, b.text) - 1)) AS snippet FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """Where each document quotes a benchmark item, with the text around it."""
    from tallyforge.operators import retrieval

    return retrieval.phrase_hits(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")
