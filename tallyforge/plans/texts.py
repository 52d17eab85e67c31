"""Notations, names, identifiers and payloads of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.functions import numbers
from tallyforge.functions import records as rec
from tallyforge.plans.common import REPORTS, reports

ACRONYMS = {"erbl": "early results baseline", "it": "investment target", "on": "outcome number"}
RATINGS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("taxonomy_prefixes", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'FY' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS fiscal_year, p_type AS rest FROM part")
def taxonomy_prefixes(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit("FY"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" - "), F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", rec.fiscal_prefix(name).alias("x")).select("p_partkey", "x.fiscal_year", "x.rest")


@query(
    "templated_descriptions",
    f"WITH {REPORTS} SELECT record_id, 'Report ' || seq || ' of ' || entity || ' is rated ' || rating || ' after ' || coalesce(CAST(lag(rating) OVER (PARTITION BY entity ORDER BY seq) AS VARCHAR), 'not stated') || '.' AS description FROM reports",
)
def templated_descriptions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = reports(spark, d).withColumn("previous", F.lag("rating").over(Window.partitionBy("entity").orderBy("seq")))
    return rows.select("record_id", rec.templated("Report {seq} of {entity} is rated {rating} after {previous}.", seq=F.col("seq"), entity=F.col("entity"), rating=F.col("rating"), previous=F.col("previous")).alias("description"))


@query("short_titles", "SELECT doc_id, substr(text, 1, 120) AS title FROM documents")
def short_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rec.short_title(F.col("text")).alias("title"))


@query(
    "clean_unicode_text",
    "SELECT doc_id, replace(replace(translate(nfc_normalize('e' || chr(769) || chr(64257) || chr(8203) || ' ' || text), chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173), ''), chr(64257), 'fi'), chr(64258), 'fl') AS text FROM documents",
)
def clean_unicode_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("éﬁ​ "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", rec.clean_unicode(raw).alias("text"))


@query(
    "loan_numbers",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'STATEMENT' WHEN 3 THEN NULL ELSE 'LEGAL' END AS notation, CASE WHEN o_orderkey % 4 < 2 THEN 'IBRD' END AS lender,
CASE WHEN o_orderkey % 4 < 3 THEN CAST(1000 + o_custkey % 9000 AS VARCHAR) END AS base,
CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 3 THEN NULL ELSE 'IN' END AS tail,
CASE o_orderkey % 4 WHEN 0 THEN 'IBRD-' || (1000 + o_custkey % 9000) || '-0' WHEN 1 THEN 'IBRD-' || (1000 + o_custkey % 9000) || '-IN' WHEN 2 THEN (1000 + o_custkey % 9000) || '-IN' END AS normalized FROM orders""",
)
def loan_numbers(spark: SparkSession, d: str) -> DataFrame:
    base, kind = (F.lit(1000) + F.col("o_custkey") % 9000).cast("string"), F.col("o_orderkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit(" ibrd "), base, F.lit("0"))).when(kind == 1, F.concat(F.lit("IBRD - "), base, F.lit(" -in "))).when(kind == 2, F.concat(base, F.lit("-IN"))).otherwise(F.concat(F.lit("Loan "), base))
    return table(spark, d, "orders").select("o_orderkey", rec.loan_number(raw).alias("x")).select("o_orderkey", "x.*")


@query(
    "indicator_names",
    """SELECT event_id, event_type || ' per site' AS name, CASE WHEN event_id % 3 > 0 THEN 'Number' END AS unit, CASE WHEN event_id % 3 = 2 THEN 'Custom' END AS kind,
CASE WHEN event_id % 3 > 0 AND event_id % 5 = 0 THEN 'DLI CRI' ELSE '' END AS tags, CASE WHEN event_id % 3 > 0 AND event_id % 2 = 0 THEN 'Off-track' END AS status FROM events""",
)
def indicator_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    unit = F.when(i % 3 == 1, " (Number)").when(i % 3 == 2, " (Number, Custom)").otherwise("")
    after = F.when(i % 3 > 0, F.concat(F.when(i % 5 == 0, " DLI CRI").otherwise(""), F.when(i % 2 == 0, "  Off-track ").otherwise(""))).otherwise("")
    raw = F.concat(F.lit("► "), F.upper("event_type"), F.lit("  per Site"), unit, after)
    return table(spark, d, "events").select("event_id", rec.indicator_name(raw).alias("x")).select("event_id", "x.name", "x.unit", "x.kind", F.array_join("x.tags", " ").alias("tags"), "x.status")


_EXPAND = " || ".join(f"CASE WHEN regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}]){a}(?:$|[^\\p{{L}}\\p{{N}}])') THEN ' {x}' ELSE '' END" for a, x in ACRONYMS.items())


@query("acronyms_expanded", f"SELECT item_id, text || {_EXPAND} AS question FROM benchmark")
def acronyms_expanded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", rec.expanded(F.col("text"), ACRONYMS).alias("question"))


@query("evidence_snippets", "SELECT doc_id, CASE WHEN position('the ' IN text) > 0 THEN substr(text, greatest(1, position('the ' IN text) - 40), 84 - greatest(0, 41 - position('the ' IN text))) END AS snippet FROM documents")
def evidence_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rec.snippet(F.col("text"), "the ").alias("snippet"))


@query(
    "report_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + 40 END AS day, CASE WHEN o_orderkey % 3 > 0 THEN 'HEADER' WHEN o_orderkey % 5 > 0 THEN 'ARCHIVE' ELSE 'UNKNOWN' END AS basis, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN 40 END AS difference FROM orders",
)
def report_dates(spark: SparkSession, d: str) -> DataFrame:
    day, i = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", rec.report_date(F.when(i % 3 > 0, day), F.when(i % 5 > 0, F.date_add(day, 40))).alias("x")).select("o_orderkey", "x.*")


@query(
    "rendered_dates",
    "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, strftime(d, '%Y-%m-%d') || '|' || strftime(d, '%B %-d, %Y') || '|' || strftime(d, '%-d %B %Y') || '|' || strftime(d, '%b %-d, %Y') || '|' || strftime(d, '%-d %b %Y') AS forms FROM o",
)
def rendered_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.array_join(rec.date_forms(F.col("o_orderdate").cast("date")), "|").alias("forms"))


@query("wrapped_numbers", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(38,6)) AS amount FROM orders")
def wrapped_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Amounts printed with thousands separators and a break before their last digit."""
    printed = F.format_number("o_totalprice", 2)
    broken = F.concat(F.lit(" "), F.substr(printed, F.lit(1), F.length(printed) - 1), F.lit(" \n"), F.substr(printed, F.length(printed), F.lit(1)))
    return table(spark, d, "orders").select("o_orderkey", numbers.printed_number(rec.unwrapped_number(broken)).alias("amount"))


@query(
    "plain_values",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(38,6)) END AS amount, CASE WHEN o_orderkey % 3 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders",
)
def plain_values(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    amount = F.concat(F.when(i % 2 == 1, "USD ").otherwise(""), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    year = F.concat(F.date_format("o_orderdate", "yyyy"), F.when(i % 3 == 0, "/98").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", numbers.plain_decimal(amount).alias("amount"), numbers.year(year).alias("year"))


@query("canonical_rows", f"""WITH {REPORTS} SELECT record_id, sha256('{{"amount":"' || amount || '","day":"' || day || '","rating":' || rating || '}}') AS digest FROM reports""")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reports(spark, d)
    return rows.select("record_id", F.sha2(rec.canonical_json(rows, ["rating", "day", "amount"]), 256).alias("digest"))


@query("check_details", """SELECT o_custkey, '{"orders":"' || count(*) || '","worst":"' || min(o_orderpriority) || '"}' AS details FROM orders GROUP BY o_custkey""")
def check_details(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("worst"))
    return per.select("o_custkey", F.to_json(F.create_map(F.lit("orders"), F.col("n").cast("string"), F.lit("worst"), F.col("worst"))).alias("details"))


@query("flattened_payload", """SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '$.more.list[' || i || ']', CASE i WHEN 0 THEN event_type ELSE 'null' END FROM events, (VALUES (0), (1)) v(i)""")
def flattened_payload(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"more":{"list":["'), F.col("event_type"), F.lit('",null]}}'))
    return rec.payload_strings(table(spark, d, "events").withColumn("payload", payload), "event_id", "payload")


@query("page_sets", "SELECT l_orderkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS pages FROM (SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber + 1 FROM lineitem) GROUP BY l_orderkey")
def page_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each line covers its page and the next."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array("l_linenumber", F.col("l_linenumber") + 1)).alias("page"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("page").cast("string"))), ",").alias("pages"))


@query("ordinal_ranks", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS rank FROM orders")
def ordinal_ranks(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 7 == 0, "UNKNOWN").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", rec.rank_of(value, RATINGS).alias("rank"))


@query("struct_columns", """SELECT o_orderkey, o_orderstatus AS state_status, '{"day":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '"}' AS state_dated, '["' || o_orderpriority || '"]' AS state_marks FROM orders""")
def struct_columns(spark: SparkSession, d: str) -> DataFrame:
    state = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderdate").cast("date").alias("day")).alias("dated"), F.array("o_orderpriority").alias("marks"))
    rows = table(spark, d, "orders").select("o_orderkey", state.alias("state"))
    return rows.select("o_orderkey", *rec.flattened(rows, "state", "state_"))


@query(
    "pruned_payload",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"name":"' || c_name || '"' END || CASE WHEN c_custkey % 2 = 0 THEN ',"segments":["' || c_mktsegment || '"]' ELSE '' END || '}' AS payload FROM customer""",
)
def pruned_payload(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(i % 3 > 0, F.col("c_name")).otherwise("").alias("name"), F.when(i % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("segments"), F.lit("customer.parquet").alias("source"), F.lit(None).cast("string").alias("note"))
    return rows.select("c_custkey", rec.pruned_json(rows, ("source",)).alias("payload"))
