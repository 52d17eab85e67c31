"""Scoped retrieval, evidence, claims, budgets and tools over chunks that stand for the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import scope as sc
from tallyforge.operators.prefix import packed

_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, doc_id % 5 AS project_id, CASE WHEN doc_id % 7 = 0 THEN 'PARENT' ELSE 'RETRIEVAL' END AS chunk_role, source AS document_type, doc_id // 10 AS document_id, doc_id % 12 AS isr_sequence, CASE WHEN doc_id % 6 > 0 THEN DATE '2010-01-01' + CAST(doc_id % 3000 AS INTEGER) END AS document_date, (doc_id // 7) * 7 AS parent_chunk_id, text AS chunk_text FROM documents)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("chunk_id"), (i % 5).alias("project_id"), F.when(i % 7 == 0, "PARENT").otherwise("RETRIEVAL").alias("chunk_role"), F.col("source").alias("document_type"), F.floor(i / 10).alias("document_id"), (i % 12).alias("isr_sequence"),
        F.when(i % 6 > 0, F.date_add(F.lit("2010-01-01").cast("date"), (i % 3000).cast("int"))).alias("document_date"), (F.floor(i / 7) * 7).alias("parent_chunk_id"), F.col("text").alias("chunk_text"),
    )


@query("scoped_chunks", f"WITH {_CHUNKS} SELECT chunk_id, document_id, isr_sequence FROM chunks WHERE project_id = 2 AND chunk_role = 'RETRIEVAL' AND isr_sequence IN (1, 2, 3, 5, 8) AND document_date BETWEEN DATE '2010-01-05' AND DATE '2017-12-31'")
def scoped_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = sc.Scope(2, sequences=(1, 2, 3, 5, 8), since="2010-01-05", until="2017-12-31")
    return sc.scoped(_chunks(spark, d), s).select("chunk_id", "document_id", "isr_sequence")


@query("scope_isolation", f"WITH {_CHUNKS} SELECT p AS probed, 0 AS foreign_rows, count(*) FILTER (project_id = p AND chunk_role = 'RETRIEVAL') AS own_rows FROM chunks, range(5) r(p) GROUP BY p")
def scope_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Each project's scope probed for rows of any other: there must be none."""
    from functools import reduce

    chunks = _chunks(spark, d)
    probe = lambda p: sc.scoped(chunks, sc.Scope(p)).agg(F.count_if(F.col("project_id") != p).alias("foreign_rows"), F.count(F.lit(1)).alias("own_rows")).select(F.lit(p).cast("long").alias("probed"), "foreign_rows", "own_rows")
    return reduce(DataFrame.unionByName, (probe(p) for p in range(5)))


@query("parent_context", f"WITH {_CHUNKS} SELECT c.chunk_id, sha256(p.chunk_text) AS parent_digest FROM chunks c LEFT JOIN chunks p ON c.parent_chunk_id = p.chunk_id WHERE c.chunk_role = 'RETRIEVAL'")
def parent_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return sc.with_parents(chunks.filter("chunk_role = 'RETRIEVAL'"), chunks).select("chunk_id", F.sha2("parent_text", 256).alias("parent_digest"))


@query("latest_scope", f"WITH {_CHUNKS} SELECT chunk_id, project_id, isr_sequence FROM (SELECT *, max(isr_sequence) OVER (PARTITION BY project_id) AS top FROM chunks) WHERE isr_sequence = top")
def latest_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each project's latest report."""
    return sc.latest_only(_chunks(spark, d), "project_id", "isr_sequence").select("chunk_id", "project_id", "isr_sequence")


@query(
    "reranked_orders",
    "WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rerank_score FROM orders) SELECT o_custkey, o_orderkey, rerank_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rerank_score DESC, rank) AS new_rank FROM f) WHERE new_rank <= 5",
)
def reranked_orders(spark: SparkSession, d: str) -> DataFrame:
    """A second score with many ties: they keep their first rank."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    found = table(spark, d, "orders").withColumn("rank", nth)
    return sc.reranked(found, "o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int"), 5).select("o_custkey", "o_orderkey", "rerank_score", "new_rank")


@query("evidence_status", "WITH f AS (SELECT user_id, max(value) AS best, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT c_custkey AS user_id, coalesce(n, 0) AS n_evidence, best, CASE WHEN n > 0 AND best >= 100 THEN 'OK' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM customer LEFT JOIN f ON user_id = c_custkey")
def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", F.col("value").alias("score"))
    return sc.answered(found, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", 100.0)


_BATCHES = """WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
b AS (SELECT lang, doc_id, n_chars, i, 0::BIGINT AS batch, 1 AS rows_, n_chars AS chars FROM o WHERE i = 1
UNION ALL SELECT o.lang, o.doc_id, o.n_chars, o.i, CASE WHEN b.rows_ + 1 > 4 OR b.chars + o.n_chars > 4000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.rows_ + 1 > 4 OR b.chars + o.n_chars > 4000 THEN 1 ELSE b.rows_ + 1 END, CASE WHEN b.rows_ + 1 > 4 OR b.chars + o.n_chars > 4000 THEN o.n_chars ELSE b.chars + o.n_chars END FROM b JOIN o ON o.i = b.i + 1 AND o.lang IS NOT DISTINCT FROM b.lang)
SELECT lang, doc_id, batch FROM b"""


@query("planned_batches", _BATCHES)
def planned_batches(spark: SparkSession, d: str) -> DataFrame:
    """Texts in batches of at most 4 and 4,000 characters."""
    return packed(table(spark, d, "documents"), ["lang"], "doc_id", "n_chars", 4, 4000).select("lang", "doc_id", "batch")


@query(
    "derived_facts",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) * 2 END AS value, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN 'KNOWN' ELSE 'UNKNOWN' END AS status FROM orders",
)
def derived_facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact that follows from two others is unknown if one of them is."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    a, b = sc.fact(F.when(F.col("o_orderkey") % 3 > 0, price)), sc.fact(F.when(F.col("o_orderkey") % 5 > 0, price))
    rows = table(spark, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    rows = rows.select("o_orderkey", sc.fact((F.col("a.value") + F.col("b.value")).cast("decimal(20,2)"), F.col("a"), F.col("b")).alias("f"))
    return rows.select("o_orderkey", "f.value", "f.status")


@query(
    "merged_evidence",
    "WITH e AS (SELECT 'ev-' || substr(sha256(l_orderkey || '|' || l_linenumber), 1, 16) AS evidence_id, CASE WHEN l_returnflag = 'N' THEN 'search' ELSE 'timeline' END AS call, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem) SELECT evidence_id, string_agg(DISTINCT call, ',' ORDER BY call) AS calls, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict FROM e GROUP BY 1",
)
def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(sc.evidence_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("evidence_id"), F.when(F.col("l_returnflag") == "N", "search").otherwise("timeline").alias("call"), F.col("l_suppkey").cast("string").alias("value"))
    return sc.merged_evidence(rows, "evidence_id", "value")


_CLAIM = "CASE WHEN o_orderkey % 7 = 0 THEN 'NO_CITATION' WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN_CITATION' WHEN o_orderkey % 3 = 0 THEN 'PERIOD_NOT_COVERED' WHEN o_orderkey % 2 = 0 THEN 'NUMBER_NOT_IN_EVIDENCE' ELSE 'VALID' END"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    year = F.year("o_orderdate")
    status = sc.claim_status(F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(i % 5 == 0, "ev-9").otherwise("ev-1"))), F.array(F.lit("ev-1"), F.lit("ev-2")), F.array(F.when(i % 3 == 0, year + 1).otherwise(year)), F.array(year), F.when(i % 2 == 0, F.lit("7")), F.array(F.lit("5")))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", status.alias("status"))


@query("validated_claims", f"SELECT o_custkey, o_orderkey, {_CLAIM} AS status FROM orders")
def validated_claims(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d)


@query(
    "final_answers",
    f"WITH c AS (SELECT o_custkey, {_CLAIM} AS status FROM orders), n AS (SELECT o_custkey, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status NOT IN ('VALID', 'NUMBER_NOT_IN_EVIDENCE')) AS refused, count(*) FILTER (status = 'NUMBER_NOT_IN_EVIDENCE') AS conflicts FROM c GROUP BY 1) SELECT *, CASE WHEN valid = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN conflicts > 0 THEN 'PARTIAL_WITH_CONFLICTS' WHEN refused > 0 THEN 'PARTIAL' ELSE 'ANSWERED' END AS status FROM n",
)
def final_answers(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    per = _claims(spark, d).groupBy("o_custkey").agg(is_("VALID").alias("valid"), is_("NO_CITATION", "UNKNOWN_CITATION", "PERIOD_NOT_COVERED").alias("refused"), is_("NUMBER_NOT_IN_EVIDENCE").alias("conflicts"))
    return per.withColumn("status", sc.final_status(F.col("valid"), F.col("refused"), F.col("conflicts")))


@query("budget_ledger", "SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DECIMAL(38,2)) AS spent, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w <= 1000000 AS admitted FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return sc.ledger(rows, "o_custkey", "o_orderkey", "price", 1_000_000).select("o_custkey", "o_orderkey", F.col("spent").cast("decimal(38,2)").alias("spent"), "admitted")


_ANCHOR = "e AS (SELECT o_custkey, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query(
    "event_anchors",
    f"""WITH {_ANCHOR}, k AS (SELECT DISTINCT o_custkey FROM e), l AS (SELECT o_custkey, arg_max(event_id, (day, event_id)) AS x FROM e GROUP BY 1), t AS (SELECT o_custkey, event_id AS x FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, event_id) AS n FROM e) WHERE n = 3), y AS (SELECT o_custkey, min(event_id) AS x, count(*) AS c FROM e WHERE year(day) = 1997 GROUP BY 1)
SELECT o_custkey, 'last' AS anchor, x AS event_id, 'RESOLVED' AS status FROM l UNION ALL SELECT k.o_custkey, 'third', x, CASE WHEN x IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END FROM k LEFT JOIN t USING (o_custkey) UNION ALL SELECT k.o_custkey, 'of 1997', CASE WHEN c = 1 THEN x END, CASE WHEN c = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END FROM k LEFT JOIN y USING (o_custkey)""",
)
def event_anchors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("day"))
    of = lambda name, which, n=None: sc.anchored(e, "o_custkey", ["day", "event_id"], which, n).select("o_custkey", F.lit(name).alias("anchor"), "event_id", "status")
    return of("last", "last").unionByName(of("third", "ordinal", 3)).unionByName(of("of 1997", "year", 1997))


@query("truncated_timeline", "SELECT o_custkey, o_orderkey, total, total > 8 AS truncated FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE n <= 8")
def truncated_timeline(spark: SparkSession, d: str) -> DataFrame:
    return sc.truncated(table(spark, d, "orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 8).select("o_custkey", "o_orderkey", "total", "truncated")


@query(
    "financial_status",
    "WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS disbursed, count(*) AS lines FROM lineitem GROUP BY 1), e AS (SELECT user_id, count(*) AS changes FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS principal, CAST(disbursed AS DECIMAL(38,2)) AS reported, coalesce(lines, 0) AS lines, coalesce(changes, 0) AS changes, CASE WHEN disbursed IS NULL THEN 'ONE_SOURCE' ELSE 'SOURCES_NOT_RECONCILED' END AS note FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN e ON user_id = o_custkey",
)
def financial_status(spark: SparkSession, d: str) -> DataFrame:
    """Loans, what reports say of them, and a project's financial events side by side; the sources are never reconciled."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("reported"), F.count(F.lit(1)).alias("lines"))
    changes = table(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("changes"))
    rows = table(spark, d, "orders").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(changes, F.col("user_id") == F.col("o_custkey"), "left")
    return rows.select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("principal"), "reported", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("changes", F.lit(0)).alias("changes"), F.when(F.col("reported").isNull(), "ONE_SOURCE").otherwise("SOURCES_NOT_RECONCILED").alias("note"))


@query(
    "indicator_ladder",
    """WITH q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN lower(p_brand) WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE 'nothing' END AS asked, * EXCLUDE (p_partkey) FROM part)
SELECT p_partkey, asked, CASE p_partkey % 4 WHEN 0 THEN 'ID' WHEN 1 THEN 'NAME' WHEN 2 THEN 'ALL_WORDS' ELSE 'NOT_FOUND' END AS basis FROM q""",
)
def indicator_ladder(spark: SparkSession, d: str) -> DataFrame:
    """What is asked for is looked up by id, then by name, then by all its words in any order."""
    p, words = table(spark, d, "part"), F.split("p_name", " ")
    kind = F.col("p_partkey") % 4
    asked = F.when(kind == 0, F.col("p_partkey").cast("string")).when(kind == 1, F.lower("p_brand")).when(kind == 2, F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0)))).otherwise("nothing")
    rows = p.withColumn("asked", asked)
    basis = F.when(F.col("asked") == F.col("p_partkey").cast("string"), "ID").when(F.lower("p_brand") == F.col("asked"), "NAME").when(F.size(F.array_except(F.split("asked", " "), words)) == 0, "ALL_WORDS").otherwise("NOT_FOUND")
    return rows.select("p_partkey", "asked", basis.alias("basis"))


@query("temporal_claims", "SELECT o_custkey, CASE WHEN count(DISTINCT year(o_orderdate)) FILTER (o_orderstatus = 'P') = 0 THEN 'NO_PERIOD' WHEN bool_and(y_ok) FILTER (o_orderstatus = 'P') THEN 'COVERED' ELSE 'NOT_COVERED' END AS status FROM (SELECT *, max(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, year(o_orderdate)) = 1 AS y_ok FROM orders) GROUP BY o_custkey")
def temporal_claims(spark: SparkSession, d: str) -> DataFrame:
    """Whether the years that claims speak of are among those of the evidence."""
    claim = F.col("o_orderstatus") == "P"
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(claim, F.year("o_orderdate"))).alias("said"), F.collect_set(F.when(~claim, F.year("o_orderdate"))).alias("known"))
    status = F.when(F.size("said") == 0, "NO_PERIOD").when(F.size(F.array_except("said", "known")) == 0, "COVERED").otherwise("NOT_COVERED")
    return per.select("o_custkey", status.alias("status"))
