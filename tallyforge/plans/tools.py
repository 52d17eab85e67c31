"""Answers of the tools, checks of parsed documents and their loans, and papers of additional financing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, sql_of, table
from tallyforge.operators import grammar, quality, tools
from tallyforge.plans import gold
from tallyforge.plans.reports import _c, _orders, _rows

_SEVERITY = "list_position(['HIGH', 'WATCH', 'INFO'], severity)"


@query(
    "signals_answered",
    f"""SELECT project_id, signal_id, severity, signal_category, observed_date, row_number() OVER (PARTITION BY project_id ORDER BY {_SEVERITY}, signal_category, observed_date DESC NULLS LAST, signal_id) AS place
FROM ({sql_of("attention_signals")}) WHERE signal_status = 'CURRENT' AND severity IN ('WATCH', 'HIGH')""",
)
def signals_answered(spark: SparkSession, d: str) -> DataFrame:
    """What stands now and is to be watched, the gravest first."""
    rows = tools.attention(gold.attention_signals(spark, d), "project_id", "CURRENT", "WATCH")
    return rows.select("project_id", "signal_id", "severity", "signal_category", "observed_date", "place")


_TYPE = "coalesce(list_position(['FORMAL_RISK_RATING', 'ASSESSMENT_FINDING', 'ISR_SORT_RATING'], record_type), 99)"


@query(
    "risks_answered",
    f"""SELECT project_id, risk_or_finding_id, record_type, rating_rank, row_number() OVER (PARTITION BY project_id ORDER BY {_TYPE}, rating_rank DESC NULLS LAST, observed_date NULLS LAST, risk_or_finding_id) AS place
FROM ({sql_of("risk_register")})""",
)
def risks_answered(spark: SparkSession, d: str) -> DataFrame:
    return tools.risks(gold.risk_register(spark, d), "project_id").select("project_id", "risk_or_finding_id", "record_type", "rating_rank", "place")


@query(
    "answers_found",
    f"""SELECT c_custkey AS project_id, CASE WHEN count(signal_id) > 0 THEN 'OK' ELSE 'EMPTY' END AS status, count(signal_id) AS items
FROM customer LEFT JOIN (SELECT * FROM ({sql_of("attention_signals")}) WHERE severity = 'HIGH' AND signal_category IN ('SCHEDULE', 'FINANCE')) ON project_id = c_custkey GROUP BY 1""",
)
def answers_found(spark: SparkSession, d: str) -> DataFrame:
    """Whether each project has grave signals of its schedule or its finance at any time; projects without any are EMPTY."""
    asked = ("SCHEDULE", "FINANCE")
    rows = tools.attention(gold.attention_signals(spark, d, asked), "project_id", "ALL", "HIGH", asked)
    return tools.answered(table(spark, d, "customer").select(F.col("c_custkey").alias("project_id")), rows, "project_id")


@query(
    "document_loan_links",
    """WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(1000 + (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 9000 AS VARCHAR) END AS base FROM orders WHERE o_orderkey % 5 > 0),
l AS (SELECT c_custkey, CAST(1000 + c_custkey % 9000 AS VARCHAR) AS base, unnest(CASE WHEN c_custkey % 7 = 0 THEN [0, 1] ELSE [0] END) AS k FROM customer), p AS (SELECT c_custkey, base, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT o_orderkey, CASE WHEN r.base IS NULL THEN 'UNRECOGNISED' WHEN n IS NULL THEN 'NO_MATCH' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'LINKED' END AS status, r.base FROM r LEFT JOIN p ON c_custkey = o_custkey AND p.base = r.base)
SELECT o_orderkey, CASE status WHEN 'LINKED' THEN 'DOCUMENT_LOAN_REFERENCE_LINKED' ELSE 'DOCUMENT_LOAN_REFERENCE_UNLINKED' END AS code, CASE status WHEN 'LINKED' THEN 'INFO' ELSE 'WARNING' END AS severity, status, CASE status WHEN 'LINKED' THEN 'IBRD' || base || '0' END AS matched FROM s""",
)
def document_loan_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders state a loan of their customer in one of two notations, some another one, some what is none, some nothing."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    base = (F.lit(1000) + (F.col("o_custkey") + F.when(k % 3 == 0, 1).otherwise(0)) % 9000).cast("string")
    raw = F.when(k % 5 == 0, " ").when(k % 4 == 0, F.concat(F.lit(" ibrd "), base, F.lit("0"))).when(k % 4 == 1, F.concat(F.lit("IBRD - "), base, F.lit(" -in "))).when(k % 4 == 2, F.concat(base, F.lit("-IN"))).otherwise(F.concat(F.lit("Loan "), base))
    stated = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"), raw.alias("raw"))
    own = (F.lit(1000) + c % 9000).cast("string")
    both = F.array_compact(F.array(F.concat(F.lit("IBRD"), own, F.lit("0")), F.when(c % 7 == 0, F.concat(own, F.lit("-IN")))))
    loans = table(spark, d, "customer").select(c.alias("project_id"), F.explode(both).alias("loan_number"))
    return tools.loan_links(stated, loans, "o_orderkey", "project_id", "raw")


_PARSED = """p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE count(l_orderkey) END AS pages, count(l_orderkey) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS pdf_pages, count(*) FILTER (l_returnflag = 'A') AS empty_pages, CAST(coalesce(sum(l_quantity), 0) * 15 AS BIGINT) AS clean_chars,
CASE o_orderkey % 5 WHEN 0 THEN 'ISR' WHEN 1 THEN 'ADDITIONAL_FINANCING' WHEN 2 THEN 'OTHER' WHEN 3 THEN 'AGREEMENT' END AS kind, (100 - o_orderkey % 12) / 100.0::DOUBLE AS coverage, o_orderkey % 19 = 0 AS invalid, o_custkey % 11 = 0 AS filed,
o_custkey % 13 = 0 AS corrected, o_custkey % 17 = 0 AS conflict, o_orderkey % 9 > 0 AS sequence, o_orderkey % 8 > 0 AS dated, CAST(o_orderdate AS DATE) AS report_date, CAST(min(l_shipdate) AS DATE) AS archive_date, count(*) FILTER (l_returnflag = 'R') AS dropped, count(*) FILTER (l_linestatus = 'O') AS warned
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"""
_S = "CAST({} AS VARCHAR)".format


def _case(code: str, severity: str, when: str, detail: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT id, '{code}' AS code, {severity} AS severity, {detail} AS detail FROM p WHERE {when}"


_ISR, _KEY = "pages > 0 AND kind = 'ISR' AND ", "pages > 0 AND coalesce(kind IN ('ISR', 'ADDITIONAL_FINANCING'), false) AND clean_chars < 1000"
_CHECKS = [
    _case("PDF_PAGE_COUNT_MISMATCH", "'ERROR'", "pages <> pdf_pages"),
    _case("NO_USABLE_TEXT", "'ERROR'", "pages = 0", "'no pages'"),
    _case("EMPTY_PAGES", "CASE WHEN empty_pages > 0.25 * pages THEN 'WARNING' ELSE 'INFO' END", "pages > 0 AND empty_pages > 0", _S("empty_pages")),
    _case("NO_USABLE_TEXT", "'ERROR'", _KEY, _S("clean_chars")),
    _case("LOW_TEXT_EXTRACTION", "'WARNING'", f"pages > 0 AND NOT ({_KEY}) AND clean_chars < 400 * pages"),
    _case("LOW_TEXT_COVERAGE", "'WARNING'", "pages > 0 AND coverage < 0.95"),
    _case("PAGE_PROVENANCE_INVALID", "'ERROR'", "pages > 0 AND invalid", "'1'"),
    _case("DOCUMENT_PROJECT_MISMATCH", "'ERROR'", "pages > 0 AND filed"),
    _case("METADATA_CORRECTED_FROM_DOCUMENT", "'WARNING'", "pages > 0 AND corrected", "'document_type'"),
    _case("METADATA_CONFLICT", "'WARNING'", "pages > 0 AND conflict", "'report_number'"),
    _case("DOCUMENT_TYPE_UNRESOLVED", "'ERROR'", "pages > 0 AND coalesce(kind, 'OTHER') = 'OTHER'"),
    _case("MISSING_EXPECTED_METADATA", "'ERROR'", _ISR + "NOT sequence", "'isr_sequence'"),
    _case("MISSING_EXPECTED_METADATA", "'ERROR'", _ISR + "archive_date IS NULL", "'archive_date'"),
    _case("MISSING_EXPECTED_METADATA", "'ERROR'", _ISR + "conflict", "'report_number'"),
    _case("MISSING_EXPECTED_METADATA", "'WARNING'", _ISR + "NOT dated", "'report_date'"),
    _case("ISR_DATES_DIFFER", "'INFO'", _ISR + "dated AND report_date <> archive_date"),
    _case("MISSING_EXPECTED_METADATA", "'INFO'", "pages > 0 AND coalesce(kind, '') <> 'ISR' AND NOT dated", "'document_date'"),
    _case("TABLE_CELLS_DROPPED", "'WARNING'", "pages > 0 AND dropped > 0", _S("dropped")),
    _case("PARSER_WARNING", "'INFO'", "pages > 0 AND warned > 0", _S("warned")),
]


@query("document_checks", f"WITH {_PARSED} {' UNION ALL '.join(_CHECKS)}")
def document_checks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as parsed documents, their lines as pages."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("empty"), F.sum("l_quantity").alias("quantity"), F.min("l_shipdate").alias("shipped"), F.count_if(F.col("l_returnflag") == "R").alias("dropped"), F.count_if(F.col("l_linestatus") == "O").alias("warned")
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    named = lambda when, name: F.when(when, F.array(F.lit(name)))
    dated, kind = F.when(k % 8 > 0, F.col("o_orderdate").cast("date")), F.when(k % 5 == 0, "ISR").when(k % 5 == 1, "ADDITIONAL_FINANCING").when(k % 5 == 2, "OTHER").when(k % 5 == 3, "AGREEMENT")
    docs = table(spark, d, "orders").join(lines, F.col("l_orderkey") == k, "left").select(
        k.alias("id"), F.when(k % 23 == 0, 0).otherwise(zero("n")).alias("pages"), (zero("n") + F.when(k % 7 == 0, 1).otherwise(0)).alias("pdf_pages"), zero("empty").alias("empty_pages"), (zero("quantity") * 15).cast("long").alias("clean_chars"),
        kind.alias("document_type"), ((100 - k % 12) / F.lit(100.0)).alias("coverage"), F.when(k % 19 == 0, 1).otherwise(0).alias("invalid_elements"), (c % 11 == 0).alias("filed_elsewhere"), named(c % 13 == 0, "document_type").alias("corrected"), named(c % 17 == 0, "report_number").alias("conflicting"),
        F.when(k % 9 > 0, k).alias("isr_sequence"), F.col("shipped").cast("date").alias("archive_date"), F.when(c % 17 != 0, c).alias("report_number"), dated.alias("report_date"), dated.alias("document_date"), zero("dropped").alias("dropped_cells"), zero("warned").alias("other_warnings"),
    )
    return quality.document_checks(docs, "id")


@query(
    "additional_financing",
    """SELECT o_orderkey AS document_id, 2 AS page, 3 AS table_no, r.row_no, CASE r.row_no WHEN 6 THEN CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR END AS amount, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) ELSE DATE '1990-01-01' END AS event_date, CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_custkey END AS project, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS financing_type
FROM orders, (VALUES (6), (8)) r(row_no)""",
)
def additional_financing(spark: SparkSession, d: str) -> DataFrame:
    """Papers with approval dates on two of three pages or on the last alone, the first counts; the lender's row stands twice, once with no number."""
    o, k = _orders(spark, d), F.col("o_orderkey")
    day = F.concat(F.lit("Approval Date  "), F.date_format("day", "dd-MMM-yyyy"))
    rows = _rows(
        o,
        (1, 1, _c("Financing", F.when(k % 3 == 0, day).otherwise("Approval Date"))),
        (1, 2, F.when(k % 2 == 0, _c("Project ID", "Additional Financing Type"))),
        (1, 2, F.when(k % 2 == 0, _c(F.concat(F.lit("P"), F.col("o_custkey")), F.col("o_orderpriority")))),
        (2, 3, _c("Source", "Proposed Additional Financing (US$m)")),
        (2, 3, _c("Total", "99")),
        (2, 3, _c(F.when(k % 3 == 1, day).otherwise("of which IDA"), "1")),
        (2, 3, _c(" of which IBRD", F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))),
        (3, 1, _c("Approval Date 01-Jan-1990", "")),
        (2, 3, _c("Of which IBRD/IDA", "n/a")),
    )
    found = grammar.additional_financing(rows)
    return found.withColumn("amount", F.col("amount").cast("decimal(18,2)").cast("string"))
