"""Contracts, snapshot merges, manifests and governed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.functions.temporal import parse
from tallyforge.operators import reads, store
from tallyforge.operators.contracts import ColumnSpec, Contract
from tallyforge.plans.common import REPORTS, reports

ORDERS = Contract("orders", ("o_orderkey",), (ColumnSpec("o_orderkey", "bigint", False, "KEY"), ColumnSpec("o_custkey", "bigint", False), ColumnSpec("o_orderstatus", "string", False, vocabulary=("O", "F", "P")), ColumnSpec("total", "decimal(38,6)"), ColumnSpec("day", "date"), ColumnSpec("loaded", "string", role="OPERATIONAL")))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.col("o_orderdate").cast("date").alias("day"), F.lit("run").alias("loaded"))


@query("contract_identity", "SELECT o_orderkey, substr(sha256('orders' || chr(31) || o_orderkey), 1, 32) AS record_id, 's1' AS snapshot FROM orders")
def contract_identity(spark: SparkSession, d: str) -> DataFrame:
    return ORDERS.finalize(_rows(spark, d), "s1").select("o_orderkey", "record_id", F.col("_source_snapshot_id").alias("snapshot"))


@query("contract_violations", "SELECT * FROM (VALUES ('NULL_o_orderkey'), ('NULL_o_custkey'), ('NULL_o_orderstatus'), ('VOCABULARY_o_orderstatus'), ('DUPLICATE_ID'), ('HASH_DRIFT')) v(\"check\"), (SELECT count(*) FILTER (false) AS n FROM orders)")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return ORDERS.violations(ORDERS.finalize(_rows(spark, d), "s1"))


_SIDES = """cur AS (SELECT o_orderkey AS id, sha256(o_orderkey || '|' || o_orderstatus) AS h FROM orders WHERE o_orderkey % 10 <> 0),
inc AS (SELECT o_orderkey AS id, sha256(o_orderkey || '|' || CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 9 <> 0)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    h = lambda status: F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), status), 256).alias("h")
    cur = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), h(F.col("o_orderstatus")), F.lit(1).alias("load"))
    inc = o.filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), h(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))), F.lit(2).alias("load"))
    return cur, inc


@query("merge_actions", f"WITH {_SIDES} SELECT coalesce(cur.id, inc.id) AS id, CASE WHEN cur.id IS NULL THEN 'INSERT' WHEN inc.id IS NULL THEN 'DELETE' WHEN cur.h = inc.h THEN 'KEEP' ELSE 'UPDATE' END AS action FROM cur FULL JOIN inc ON cur.id = inc.id")
def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    return store.merge_plan(*_sides(spark, d), "id", "h")


@query("merged_table", f"WITH {_SIDES} SELECT inc.id, inc.h, CASE WHEN cur.h = inc.h THEN 1 ELSE 2 END AS load FROM inc LEFT JOIN cur ON cur.id = inc.id")
def merged_table(spark: SparkSession, d: str) -> DataFrame:
    return store.merged(*_sides(spark, d), "id", "h")


@query("cache_delta", "SELECT DISTINCT sha256(text) AS text_sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def cache_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return store.missing_only(rows.filter("doc_id % 3 = 0"), rows.select("text_sha256"), ["text_sha256"])


@query("manifest_verified", "WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 8 <> 1), f AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 8 <> 2) SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, CASE WHEN m.doc_id IS NULL THEN 'UNEXPECTED' WHEN f.doc_id IS NULL THEN 'MISSING' WHEN m.h = f.h THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM m FULL JOIN f ON m.doc_id = f.doc_id")
def manifest_verified(spark: SparkSession, d: str) -> DataFrame:
    from tallyforge.sources.files import verified

    docs = table(spark, d, "documents")
    manifest = docs.filter("doc_id % 8 <> 1").select("doc_id", F.sha2("text", 256).alias("h"))
    found = docs.filter("doc_id % 8 <> 2").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("h"))
    return verified(manifest, found, "doc_id", "h")


@query("governed_read", f"WITH {REPORTS} SELECT record_id, day, rating, amount FROM reports WHERE entity = 7 AND rating IN (1, 2, 3) AND amount >= 1000 AND day >= DATE '1993-01-01' ORDER BY day LIMIT 2000")
def governed_read(spark: SparkSession, d: str) -> DataFrame:
    since = parse("what happened since 1993").low
    request = reads.ReadRequest("reports", 7, ("record_id", "day", "rating", "amount"), (reads.Filter("rating", "in", (1, 2, 3)), reads.Filter("amount", "ge", 1000), reads.Filter("day", "ge", since)), ("day", "record_id"))
    return reads.read(request, {"reports": (reports(spark, d), "entity")})


@query("guarded_read", f"WITH {REPORTS} SELECT record_id, entity, seq FROM reports WHERE entity = 11")
def guarded_read(spark: SparkSession, d: str) -> DataFrame:
    return reads.guarded(reports(spark, d).where("entity = 11"), "entity", 11).select("record_id", "entity", "seq")


@query("period_read", f"WITH {REPORTS} SELECT record_id, day FROM reports WHERE day BETWEEN DATE '1995-04-01' AND DATE '1995-06-30'")
def period_read(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).where(parse("changes in Q2 1995").predicate("day")).select("record_id", "day")


_STATES = """s AS (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders),
one AS (SELECT id, CASE WHEN id % 13 <> 0 THEN status END AS status, price FROM s WHERE id % 10 <> 0),
three AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'X' WHEN id % 13 <> 0 OR id % 2 = 0 THEN status END AS status, price + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END AS price FROM s WHERE id % 9 <> 0)"""


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three states of a table: rows come, go, and go back to what they were; nulls become values and values null."""
    i, status = F.col("id"), F.col("status")
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    price = lambda n: (F.col("price") + n).cast("decimal(18,2)").alias("price")
    one = s.filter("id % 10 <> 0").select("id", F.when(i % 13 != 0, status).alias("status"), "price")
    two = s.filter("id % 4 <> 0").select("id", F.when(i % 3 == 0, "Z").otherwise(status).alias("status"), price(F.when(i % 2 == 0, 5).otherwise(0)))
    three = s.filter("id % 9 <> 0").select("id", F.when(i % 7 == 0, "X").when((i % 13 != 0) | (i % 2 == 0), status).alias("status"), price(F.when(i % 5 == 1, 1).otherwise(0)))
    return one, two, three


@query(
    "changes_between",
    f"""WITH {_STATES}, j AS (SELECT one.id AS a, three.id AS b, one.status AS sa, three.status AS sb, one.price AS pa, three.price AS pb, concat_ws(',', CASE WHEN one.status IS DISTINCT FROM three.status THEN 'status' END, CASE WHEN one.price IS DISTINCT FROM three.price THEN 'price' END) AS changed FROM one FULL JOIN three ON one.id = three.id)
SELECT b AS id, sb AS status, CAST(pb AS DECIMAL(18,2)) AS price, 'insert' AS change, '' AS changed FROM j WHERE a IS NULL UNION ALL SELECT a, sa, pa, 'delete', '' FROM j WHERE b IS NULL
UNION ALL SELECT a, sa, pa, 'update_preimage', changed FROM j WHERE a = b AND changed <> '' UNION ALL SELECT b, sb, CAST(pb AS DECIMAL(18,2)), 'update_postimage', changed FROM j WHERE a = b AND changed <> ''""",
)
def changes_between(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of the first version has to replay to have the third: both steps' changes are written to a feed and
    read as one."""
    from tallyforge.operators import changes
    from tallyforge.staging import shared_folder

    feed, states = shared_folder(spark), _states(spark, d)
    for version in (2, 3):
        changes.record(changes.changes(*states[version - 2 : version], ["id"]), feed, version)
    return changes.between(spark.read.parquet(feed), ["id"], 1, 3).withColumn("changed", F.array_join("changed", ","))


@query(
    "tree_differences",
    f"WITH {_STATES} SELECT coalesce(one.id, three.id) AS id, CASE WHEN three.id IS NULL THEN 'MISSING' WHEN one.id IS NULL THEN 'UNEXPECTED' ELSE 'MISMATCH' END AS status FROM one FULL JOIN three ON one.id = three.id WHERE one.id IS NULL OR three.id IS NULL OR one.status IS DISTINCT FROM three.status OR one.price <> three.price",
)
def tree_differences(spark: SparkSession, d: str) -> DataFrame:
    """The rows in which two states differ, looked for in ranges of keys whose digests differ."""
    from tallyforge.operators import merkle

    one, _, three = _states(spark, d)
    return merkle.differences(one, three, ["id"])
