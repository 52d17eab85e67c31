"""Gold over Silver frames that stand for the reference's: customers are projects, orders their reports, events results."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import gold
from tallyforge.staging import staged

INSTRUMENTS = ("BUILDING", "FURNITURE", "MACHINERY")
SNAPSHOT = "1999-01-01"
#: What Gold reads of the progress of results.
PROGRESS = (
    "record_id", "project_id", "indicator_key", "isr_sequence", "observation_date", "current_value", "target_value", "target_date", "current_number", "calculation_status", "previous_record_id", "progress_percentage",
    "target_changed", "previous_target_value", "previous_number", "trend", "target_status",
)
_SILVER = f"""
reports AS (SELECT o_orderkey AS record_id, o_custkey AS project_id, CAST(o_orderdate AS DATE) AS report_date, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS isr_sequence FROM orders),
ratings AS (SELECT project_id, 'PDO' AS subject, isr_sequence, report_date, digit AS rank, record_id FROM reports UNION ALL SELECT project_id, 'IP', isr_sequence, report_date, CASE WHEN record_id % 11 > 0 THEN 1 + (digit + record_id) % 6 END, record_id FROM reports),
risks AS (SELECT project_id, isr_sequence, report_date, 1 + (record_id + digit) % 4 AS rank, record_id FROM reports),
lines AS (SELECT o_custkey AS project_id, CAST(o_orderdate AS DATE) AS ordered, CAST(l_shipdate AS DATE) AS shipped, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
projects AS (SELECT c_custkey AS project_id, c_custkey AS record_id, c_mktsegment AS financing_instrument, min(ordered) AS effective_date, CAST(min(ordered) + CAST(365 * (c_custkey % 7) AS INTEGER) AS DATE) AS original_closing_date, max(shipped) AS current_closing_date FROM customer LEFT JOIN lines ON project_id = c_custkey GROUP BY c_custkey, c_mktsegment),
events_ AS (SELECT project_id, l_orderkey * 10 + l_linenumber AS record_id, 'CLOSING_DATE_CHANGE' AS event_type, CASE WHEN l_tax > 0 THEN shipped END AS event_date, CAST(l_suppkey AS VARCHAR) AS loan_number, ordered AS old_closing_date, shipped AS new_closing_date, CAST(NULL AS DECIMAL(18,2)) AS amount, NULL AS currency FROM lines WHERE l_returnflag = 'R' AND l_discount > 0.08
 UNION ALL SELECT project_id, l_orderkey * 10 + l_linenumber, 'CANCELLATION', shipped, NULL, NULL, NULL, CASE WHEN l_tax > 0.01 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END, CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END FROM lines WHERE l_returnflag = 'A' AND l_discount > 0.08
 UNION ALL SELECT o_custkey, o_orderkey, 'ADDITIONAL_FINANCING', CAST(o_orderdate AS DATE), NULL, NULL, NULL, CAST(o_totalprice AS DECIMAL(18,2)), 'USD' FROM orders WHERE o_totalprice >= 300000
 UNION ALL SELECT user_id, event_id, 'RESTRUCTURING', CASE WHEN event_id % 4 > 0 THEN CAST(ts AS DATE) END, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_type = 'purchase'),
financial AS (SELECT project_id, DATE '{SNAPSHOT}' AS snapshot_date, count(DISTINCT l_suppkey) AS loan_count, CAST(round(CAST(count(*) FILTER (l_linestatus = 'F') * 100 AS DOUBLE) / count(*), 2) AS DECIMAL(38,2)) AS disbursed_percentage, min(l_orderkey) AS financial_id FROM lines GROUP BY project_id),
results AS (SELECT event_id AS record_id, user_id AS project_id, event_type AS indicator_key, isr_sequence, CAST(DATE '1996-01-01' + to_months(CAST(5 * isr_sequence AS INTEGER)) AS DATE) AS observation_date, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'n/a' ELSE '10' END AS baseline_value,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(CAST(floor(value / 40) AS INTEGER) * 10 AS VARCHAR) END AS current_value, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '10' WHEN event_id % 7 = 0 THEN '2,000' ELSE '1,000' END AS target_value,
  CAST(DATE '1996-06-01' + to_months(CAST(5 * (user_id % 5) AS INTEGER)) AS DATE) AS target_date, CASE WHEN event_id % 31 = 0 THEN 'AMBIGUOUS' ELSE 'EXACT' END AS status, CASE WHEN event_id % 37 = 0 THEN 'DLI' ELSE 'WIDE' END AS layout, CASE WHEN event_id % 41 = 0 THEN 'Yes/No' ELSE 'Number' END AS unit
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS isr_sequence FROM events)),
numbers AS (SELECT *, TRY_CAST(replace(baseline_value, ',', '') AS DECIMAL(38,6)) AS b, TRY_CAST(replace(current_value, ',', '') AS DECIMAL(38,6)) AS c, TRY_CAST(replace(target_value, ',', '') AS DECIMAL(38,6)) AS t FROM results),
judged AS (SELECT *, CASE WHEN status <> 'EXACT' THEN 'EXTRACTION_NOT_EXACT' WHEN layout = 'DLI' THEN 'DLI_LAYOUT_NOT_EVALUATED' WHEN unit = 'Yes/No' THEN 'QUALITATIVE_UNIT' WHEN current_value IS NULL THEN 'MISSING_CURRENT' WHEN baseline_value IS NULL THEN 'MISSING_BASELINE' WHEN target_value IS NULL THEN 'MISSING_TARGET' WHEN b IS NULL OR c IS NULL OR t IS NULL THEN 'NON_NUMERIC_VALUE' WHEN b = t THEN 'ZERO_TARGET_DISTANCE' ELSE 'OK' END AS calculation_status FROM numbers),
lagged AS (SELECT *, lag(calculation_status) OVER w AS ps, lag(c) OVER w AS pc, lag(t) OVER w AS pt, lag(target_value) OVER w AS previous_target_value, lag(record_id) OVER w AS previous_record_id, max(isr_sequence) OVER (PARTITION BY project_id, indicator_key) AS latest FROM judged WINDOW w AS (PARTITION BY project_id, indicator_key ORDER BY isr_sequence)),
progress AS (SELECT *, CASE WHEN calculation_status = 'OK' THEN round(CAST((c - b) * 100 AS DOUBLE) / CAST(t - b AS DOUBLE), 2) END AS progress_percentage, CASE WHEN calculation_status = 'OK' THEN t - c END AS target_gap, calculation_status = 'OK' AND coalesce(ps, '') = 'OK' AS both_ok,
  coalesce(target_value <> previous_target_value, false) AS target_changed, CASE WHEN calculation_status <> 'OK' THEN 'UNKNOWN' WHEN CASE WHEN t > b THEN c >= t ELSE c <= t END THEN 'MET' ELSE 'NOT_MET' END AS target_status FROM lagged),
trends AS (SELECT *, CASE WHEN NOT both_ok OR pt <> t THEN 'NOT_COMPARABLE' WHEN c = pc OR abs(t - c) = abs(t - pc) THEN 'NO_CHANGE' WHEN abs(t - c) < abs(t - pc) THEN 'TOWARD_TARGET' ELSE 'AWAY_FROM_TARGET' END AS trend, CASE WHEN both_ok THEN c - pc END AS absolute_change,
  sum(CASE WHEN calculation_status = 'OK' AND target_status = 'NOT_MET' AND ps = 'OK' AND pstat = 'NOT_MET' AND c = pc THEN 0 ELSE 1 END) OVER (PARTITION BY project_id, indicator_key ORDER BY isr_sequence) AS run FROM (SELECT *, lag(target_status) OVER (PARTITION BY project_id, indicator_key ORDER BY isr_sequence) AS pstat FROM progress))"""


def silver(spark: SparkSession, d: str, folder: str | None = None) -> dict[str, DataFrame]:
    """The Silver frames; with ``folder`` what several of them are made of is made once and staged there, progress of results too."""
    keep = lambda df, name: staged(df, folder, name) if folder else df
    orders, customer, events, lineitem = (table(spark, d, t) for t in ("orders", "customer", "events", "lineitem"))
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    reports = orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").cast("date").alias("report_date"), digit.alias("digit"), nth.alias("isr_sequence"))
    reports = keep(reports, "reports")
    other = F.when(F.col("record_id") % 11 > 0, 1 + (F.col("digit") + F.col("record_id")) % 6)
    two = F.inline(F.array(F.struct(F.lit("PDO").alias("subject"), F.col("digit").cast("long").alias("rank")), F.struct(F.lit("IP").alias("subject"), other.cast("long").alias("rank"))))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("project_id"), F.col("o_orderdate").cast("date").alias("ordered"), F.col("l_shipdate").cast("date").alias("shipped"), key.alias("record_id"), "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_extendedprice")
    spans = lines.groupBy("project_id").agg(
        F.min("ordered").alias("effective_date"), F.max("shipped").alias("current_closing_date"), F.count_distinct("l_suppkey").alias("loan_count"), F.round(F.count_if(F.col("l_linestatus") == "F") * 100.0 / F.count(F.lit(1)), 2).cast("decimal(38,2)").alias("disbursed_percentage"), F.min("l_orderkey").alias("financial_id")
    )
    spans = keep(spans, "spans")
    span = customer.join(spans, F.col("project_id") == F.col("c_custkey"), "left")
    original = F.date_add("effective_date", (365 * (F.col("c_custkey") % 7)).cast("int"))
    money = "decimal(18,2)"
    none = lambda kind: F.lit(None).cast(kind)
    closing, cancel = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    marked = lines.filter((closing | cancel) & (F.col("l_discount") > 0.08)).select(
        "project_id", "record_id", F.when(closing, "CLOSING_DATE_CHANGE").otherwise("CANCELLATION").alias("event_type"), F.when(cancel | (F.col("l_tax") > 0), F.col("shipped")).alias("event_date"), F.when(closing, F.col("l_suppkey").cast("string")).alias("loan_number"),
        F.when(closing, F.col("ordered")).alias("old_closing_date"), F.when(closing, F.col("shipped")).alias("new_closing_date"), F.when(cancel, F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice").cast(money)).otherwise(F.lit(0).cast(money))).alias("amount"), F.when(cancel, F.when(F.col("l_linestatus") == "F", "USD").otherwise("EUR")).alias("currency"),
    )
    marked = keep(marked, "marked")
    financed = orders.filter("o_totalprice >= 300000").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("record_id"), F.lit("ADDITIONAL_FINANCING").alias("event_type"), F.col("o_orderdate").cast("date").alias("event_date"), none("string").alias("loan_number"), none("date").alias("old_closing_date"), none("date").alias("new_closing_date"), F.col("o_totalprice").cast(money).alias("amount"), F.lit("USD").alias("currency"))
    rebuilt = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("record_id"), F.lit("RESTRUCTURING").alias("event_type"), F.when(F.col("event_id") % 4 > 0, F.col("ts").cast("date")).alias("event_date"), none("string").alias("loan_number"), none("date").alias("old_closing_date"), none("date").alias("new_closing_date"), none(money).alias("amount"), none("string").alias("currency"))
    i = F.col("event_id")
    series = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long")
    results = events.withColumn("isr_sequence", series).select(
        i.alias("record_id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("indicator_key"), "isr_sequence", F.add_months(F.lit("1996-01-01").cast("date"), (5 * F.col("isr_sequence")).cast("int")).alias("observation_date"),
        F.when(i % 13 == 0, None).when(i % 17 == 0, "n/a").otherwise("10").alias("baseline_value"), F.when(i % 19 > 0, (F.floor(F.col("value") / 40).cast("int") * 10).cast("string")).alias("current_value"),
        F.when(i % 23 == 0, None).when(i % 29 == 0, "10").when(i % 7 == 0, "2,000").otherwise("1,000").alias("target_value"), F.add_months(F.lit("1996-06-01").cast("date"), (5 * (F.col("user_id") % 5)).cast("int")).alias("target_date"),
        F.when(i % 31 == 0, "AMBIGUOUS").otherwise("EXACT").alias("status"), F.when(i % 37 == 0, "DLI").otherwise("WIDE").alias("layout"), F.when(i % 41 == 0, "Yes/No").otherwise("Number").alias("unit"),
    )
    made = {"progress": keep(gold.progress_of_results(results).select(*PROGRESS), "progress")} if folder else {}
    if folder:
        results = made["progress"].select("record_id", "project_id", "indicator_key", "isr_sequence")
    return made | {
        "reports": reports,
        "ratings": reports.select("project_id", "isr_sequence", "report_date", "record_id", two),
        "risks": reports.select("project_id", "isr_sequence", "report_date", "record_id", (1 + (F.col("record_id") + F.col("digit")) % 4).alias("rank")),
        "projects": span.select(F.col("c_custkey").alias("project_id"), F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("financing_instrument"), "effective_date", original.alias("original_closing_date"), "current_closing_date"),
        "financial": spans.select("project_id", F.lit(SNAPSHOT).cast("date").alias("snapshot_date"), "loan_count", "disbursed_percentage", "financial_id"),
        "events": marked.unionByName(financed).unionByName(rebuilt),
        "results": results,
    }


@query(
    "results_calculated",
    f"WITH {_SILVER} SELECT record_id, calculation_status, CAST(progress_percentage AS DOUBLE) AS progress_percentage, target_gap, absolute_change, CASE WHEN both_ok AND pc <> 0 THEN round(CAST((c - pc) * 100 AS DOUBLE) / CAST(pc AS DOUBLE), 2) END AS percentage_change, target_changed, trend, target_status FROM trends",
)
def results_calculated(spark: SparkSession, d: str) -> DataFrame:
    rows = gold.progress_of_results(silver(spark, d)["results"])
    return rows.select("record_id", "calculation_status", F.col("progress_percentage").cast("double"), "target_gap", "absolute_change", F.col("percentage_change").cast("double"), "target_changed", "trend", "target_status")


@query(
    "risk_register",
    """SELECT o_custkey AS project_id, o_orderkey AS risk_or_finding_id, CASE WHEN o_orderkey % 2 = 0 THEN 'FORMAL_RISK_RATING' ELSE 'FINDING' END AS record_type, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS category,
 CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END WHEN o_orderkey % 5 > 0 THEN 'Order ' || o_orderkey ELSE coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, '(untitled finding)') END AS title,
 o_orderstatus AS rating, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS rating_rank, NULL AS previous_rating, CAST(o_orderdate AS DATE) AS observed_date, NULL AS isr_sequence, 'APPRAISAL' AS source_document_type, 'NOT_STATED' AS resolution_status FROM orders
UNION ALL SELECT user_id, event_id, 'ISR_SORT_RATING', event_type, event_type, CASE WHEN value > 500 THEN 'O' ELSE 'F' END, CASE WHEN value > 500 THEN 2 ELSE 1 END, NULL, CAST(ts AS DATE), CAST(ts AS DATE) - DATE '2020-01-01', 'ISR', 'NOT_STATED' FROM (SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last FROM events) WHERE CAST(ts AS DATE) = last""",
)
def risk_register(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    appraisal = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), i.alias("risk_id"), F.when(i % 2 == 0, "FORMAL_RISK_RATING").otherwise("FINDING").alias("framing"), F.when(i % 3 > 0, F.col("o_orderpriority")).alias("risk_category"), F.when(i % 5 > 0, F.concat(F.lit("Order "), i.cast("string"))).alias("risk_description"), F.col("o_orderstatus").alias("risk_rating"), F.col("o_orderdate").cast("date").alias("identified_date"))
    day = F.col("ts").cast("date")
    sort = table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("record_id"), F.col("event_type").alias("risk_category"), F.when(F.col("value") > 500, "O").otherwise("F").alias("current_rating"), F.lit(None).cast("string").alias("previous_rating"), day.alias("report_date"), F.datediff(day, F.lit("2020-01-01").cast("date")).cast("long").alias("isr_sequence"))
    return gold.register_of_risks(appraisal, sort, ("F", "O")).drop("description", "provenance_class")


def _ids(*ids: str) -> str:
    return f"array_to_string(list_sort(list_filter([{', '.join(f'CAST({i} AS VARCHAR)' for i in ids)}], lambda x: x IS NOT NULL)), ',')"


_FIELDS = "rule_id, project_id, subject, severity, signal_status, observed_date, effective_sequence, current_value, comparison_value, caveats, supporting_record_ids, source_table, source_record_id"
_ISLANDS = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY isr_sequence) - row_number() OVER (PARTITION BY {k}, flag ORDER BY isr_sequence) AS run, max(isr_sequence) OVER (PARTITION BY {k}) AS latest FROM (SELECT *, coalesce({f}, false) AS flag FROM {t}))"
_STEP = "(SELECT *, lag(rank) OVER w AS p, lag(record_id) OVER w AS pid, max(isr_sequence) OVER (PARTITION BY project_id, subject) AS latest FROM ratings WINDOW w AS (PARTITION BY project_id, subject ORDER BY isr_sequence))"
_ST = "CASE WHEN isr_sequence = latest THEN 'CURRENT' ELSE 'HISTORICAL' END"
#: For each rule its columns from subject to source_record_id, and where they come from.
_RULE_SQL = {
    "RATING_DOWNGRADE": ("ratings", f"subject, CASE WHEN rank <= 3 THEN 'HIGH' ELSE 'WATCH' END, {_ST}, report_date, isr_sequence, CAST(rank AS VARCHAR), CAST(p AS VARCHAR), '', {_ids('record_id', 'pid')}, 'silver.isr_snapshots', CAST(record_id AS VARCHAR) FROM {_STEP} WHERE rank < p"),
    "RATING_RECOVERY": ("ratings", f"subject, 'INFO', {_ST}, report_date, isr_sequence, CAST(rank AS VARCHAR), CAST(p AS VARCHAR), '', {_ids('record_id', 'pid')}, 'silver.isr_snapshots', CAST(record_id AS VARCHAR) FROM {_STEP} WHERE p <= 3 AND rank > 3"),
    "RATING_BELOW_SATISFACTORY_PERSISTENT": ("ratings", "subject, CASE WHEN count(*) >= 6 THEN 'HIGH' ELSE 'WATCH' END, CASE WHEN max(isr_sequence) = max(latest) THEN 'CURRENT' ELSE 'HISTORICAL' END, max_by(report_date, isr_sequence), max(isr_sequence), CAST(count(*) AS VARCHAR), 'since report ' || min(isr_sequence), '', string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY CAST(record_id AS VARCHAR)), 'silver.isr_snapshots', CAST(max_by(record_id, isr_sequence) AS VARCHAR) FROM " + _ISLANDS.format(k="project_id, subject", f="rank <= 3", t="ratings") + " WHERE flag GROUP BY project_id, subject, run HAVING count(*) >= 3"),
    "RISK_OVERALL_RATING_ELEVATED": ("risks", "'Overall risk', CASE WHEN max_by(rank, isr_sequence) = 4 THEN 'HIGH' ELSE 'WATCH' END, 'CURRENT', max_by(report_date, isr_sequence), max(isr_sequence), CAST(max_by(rank, isr_sequence) AS VARCHAR), 'since report ' || min(isr_sequence), '', string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY CAST(record_id AS VARCHAR)), 'silver.isr_snapshots', CAST(max_by(record_id, isr_sequence) AS VARCHAR) FROM " + _ISLANDS.format(k="project_id", f="rank >= 3", t="risks") + " WHERE flag GROUP BY project_id, run HAVING max(isr_sequence) = max(latest)"),
    "RESULT_TARGET_DATE_PASSED_NOT_MET": ("results", "indicator_key, CASE WHEN progress_percentage < 50 THEN 'HIGH' ELSE 'WATCH' END, 'CURRENT', observation_date, isr_sequence, CAST(CAST(progress_percentage AS DECIMAL(38,2)) AS VARCHAR), CAST(target_date AS VARCHAR), '', CAST(r.record_id AS VARCHAR), 'silver.project_results', CAST(r.record_id AS VARCHAR) FROM trends r JOIN projects USING (project_id) WHERE isr_sequence = latest AND calculation_status = 'OK' AND target_date >= effective_date AND observation_date > target_date AND progress_percentage < 100"),
    "RESULT_MOVED_AWAY_FROM_TARGET": ("results", f"indicator_key, 'WATCH', {_ST}, observation_date, isr_sequence, current_value, CAST(CAST(pc AS DECIMAL(38,2)) AS VARCHAR), '', {_ids('record_id', 'previous_record_id')}, 'silver.project_results', CAST(record_id AS VARCHAR) FROM trends WHERE trend = 'AWAY_FROM_TARGET'"),
    "RESULT_NO_CHANGE": ("results", "indicator_key, 'INFO', CASE WHEN max(isr_sequence) = max(latest) THEN 'CURRENT' ELSE 'HISTORICAL' END, max(observation_date), max(isr_sequence), max_by(current_value, isr_sequence), CAST(count(*) AS VARCHAR), '', string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY CAST(record_id AS VARCHAR)), 'silver.project_results', CAST(max_by(record_id, isr_sequence) AS VARCHAR) FROM trends GROUP BY project_id, indicator_key, run HAVING count(*) >= 4 AND max_by(target_status, isr_sequence) = 'NOT_MET' AND max(observation_date) >= min(observation_date) + INTERVAL 12 MONTH"),
    "RESULT_TARGET_CHANGED": ("results", f"indicator_key, 'INFO', {_ST}, observation_date, isr_sequence, target_value, previous_target_value, '', {_ids('record_id', 'previous_record_id')}, 'silver.project_results', CAST(record_id AS VARCHAR) FROM trends WHERE target_changed"),
    "SCHEDULE_CLOSING_DATE_EXTENDED": ("projects", "'Project closing date', CASE WHEN current_closing_date >= original_closing_date + INTERVAL 24 MONTH THEN 'HIGH' WHEN current_closing_date >= original_closing_date + INTERVAL 12 MONTH THEN 'WATCH' ELSE 'INFO' END, 'CURRENT', last_change, NULL, CAST(current_closing_date AS VARCHAR), CAST(original_closing_date AS VARCHAR), '', array_to_string(list_sort(list_append(coalesce(ids, []), CAST(record_id AS VARCHAR))), ','), 'silver.project_enrichment', CAST(record_id AS VARCHAR) FROM projects LEFT JOIN (SELECT project_id, max(event_date) AS last_change, list(DISTINCT CAST(record_id AS VARCHAR)) AS ids FROM events_ WHERE event_type = 'CLOSING_DATE_CHANGE' GROUP BY 1) USING (project_id) WHERE current_closing_date > original_closing_date"),
    "SCHEDULE_REPEATED_CLOSING_DATE_CHANGES": ("projects", "'Closing date changes', 'WATCH', 'CURRENT', max(event_date), NULL, CAST(count(DISTINCT (loan_number, old_closing_date, new_closing_date)) AS VARCHAR), NULL, '', string_agg(DISTINCT CAST(record_id AS VARCHAR), ',' ORDER BY CAST(record_id AS VARCHAR)), 'silver.project_events', min(CAST(record_id AS VARCHAR)) FROM events_ WHERE event_type = 'CLOSING_DATE_CHANGE' AND project_id IN (SELECT project_id FROM projects) GROUP BY project_id HAVING count(DISTINCT (loan_number, old_closing_date, new_closing_date)) >= 2"),
    "FINANCE_DISBURSEMENT_LAG": ("projects", f"'Disbursement vs elapsed time', CASE WHEN elapsed - disbursed_percentage >= 40 THEN 'HIGH' ELSE 'WATCH' END, 'CURRENT', snapshot_date, NULL, CAST(disbursed_percentage AS VARCHAR), CAST(elapsed AS VARCHAR), CASE WHEN loan_count > 1 THEN 'Several loans; elapsed time is measured from the project''s effectiveness.' ELSE '' END, CAST(financial_id AS VARCHAR), 'silver.project_financial_summary', CAST(financial_id AS VARCHAR) FROM (SELECT *, CAST(round(CAST((snapshot_date - effective_date) * 100 AS DOUBLE) / (current_closing_date - effective_date), 2) AS DECIMAL(38,2)) AS elapsed FROM projects JOIN financial USING (project_id) WHERE current_closing_date > effective_date AND financing_instrument IN {INSTRUMENTS}) WHERE elapsed - disbursed_percentage >= 25"),
    "CHANGE_RESTRUCTURING": ("projects", "'Restructurings', CASE WHEN count(event_date) >= 3 THEN 'WATCH' ELSE 'INFO' END, 'CURRENT', max(event_date), NULL, CAST(count(event_date) AS VARCHAR), NULL, CASE WHEN count(*) > count(event_date) THEN (count(*) - count(event_date)) || ' more without a date.' ELSE '' END, string_agg(DISTINCT CAST(record_id AS VARCHAR), ',' ORDER BY CAST(record_id AS VARCHAR)), 'silver.project_events', min(CAST(record_id AS VARCHAR)) FROM events_ WHERE event_type = 'RESTRUCTURING' AND project_id IN (SELECT project_id FROM projects) GROUP BY project_id HAVING count(event_date) >= 1"),
    "CHANGE_ADDITIONAL_FINANCING": ("events", "'Event ' || record_id, 'INFO', 'HISTORICAL', event_date, NULL, CAST(amount AS VARCHAR), currency, '', CAST(record_id AS VARCHAR), 'silver.project_events', CAST(record_id AS VARCHAR) FROM events_ WHERE event_type = 'ADDITIONAL_FINANCING'"),
    "CHANGE_CANCELLATION": ("events", "'Event ' || record_id, 'INFO', 'HISTORICAL', event_date, NULL, CAST(amount AS VARCHAR), currency, CASE WHEN currency <> 'USD' THEN 'The amount is not in USD or its currency is not stated.' ELSE '' END, CAST(record_id AS VARCHAR), 'silver.project_events', CAST(record_id AS VARCHAR) FROM events_ WHERE event_type = 'CANCELLATION' AND amount > 0"),
}


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _full(name: str) -> str:
    """A rule's rows with the columns that follow from its name and the others."""
    r = gold.RULES[name]
    return f"""SELECT {_FIELDS}, substr(sha256('{name}|' || project_id || '|' || subject || '|' || coalesce(CAST(effective_sequence AS VARCHAR), '-')), 1, 32) AS signal_id, '{r.version}' AS rule_version, '{r.category}' AS signal_category, '{name}' AS signal_type, {_text(r.threshold)} AS threshold, {_text(r.unit)} AS value_unit, {_text(r.title)} AS signal_title,
 {_text(r.description)} || ' ' || subject || ': ' || coalesce(current_value, 'not stated') || CASE WHEN comparison_value IS NOT NULL THEN ' against ' || comparison_value ELSE '' END || '.' AS signal_description, {_text(r.description)} AS rule_description, 'SYSTEM_DERIVED_SIGNAL' AS provenance_class, NULL AS evidence_status, NULL AS document_id, NULL AS page_number, NULL AS section, NULL AS extraction_method
 FROM (SELECT '{name}', project_id, {_RULE_SQL[name][1]}) v({_FIELDS})"""


def _printed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("caveats", F.array_join("caveats", ",")).withColumn("supporting_record_ids", F.array_join("supporting_record_ids", ","))


def _rule(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One rule's signals: its group's, filtered, so that the others' structs are not made."""
    return _printed(gold.signals(silver(spark, d), INSTRUMENTS)[_RULE_SQL[name][0]]().filter(F.col("rule_id") == name))


for _name in gold.RULES:
    query(f"signal_{_name.lower()}", f"WITH {_SILVER} {_full(_name)}")(partial(_rule, name=_name))

_ALL = " UNION ALL ".join(_full(n) for n in gold.RULES)


@query("attention_signals", f"WITH {_SILVER} {_ALL}")
def attention_signals(spark: SparkSession, d: str, categories: tuple[str, ...] = ()) -> DataFrame:
    """All signals of all rules, 28 columns each; with ``categories`` those of the groups that have any of them."""
    return _printed(gold.united(gold.signals(silver(spark, d), INSTRUMENTS), categories))


@query(
    "project_overview",
    f"""WITH {_SILVER}, sig AS ({_ALL}), r AS (SELECT project_id, count(*) AS reports, max(isr_sequence) AS latest_sequence, max(report_date) AS latest_report, max_by(digit, isr_sequence) AS pdo_rank FROM reports GROUP BY 1),
e AS (SELECT project_id, count(*) FILTER (event_type = 'CLOSING_DATE_CHANGE') AS closing_changes, count(*) FILTER (event_type = 'RESTRUCTURING') AS restructurings, count(*) FILTER (event_type = 'CANCELLATION') AS cancellations, sum(amount) FILTER (event_type = 'CANCELLATION') AS cancelled FROM events_ GROUP BY 1),
i AS (SELECT project_id, count(DISTINCT indicator_key) AS indicators, count(*) FILTER (isr_sequence = latest AND target_status = 'MET') AS met FROM trends GROUP BY 1),
s AS (SELECT project_id, count(*) AS signals, count(*) FILTER (severity = 'HIGH' AND signal_status = 'CURRENT') AS high_now FROM sig GROUP BY 1)
SELECT project_id, financing_instrument, effective_date, original_closing_date, current_closing_date, disbursed_percentage, coalesce(loan_count, 0) AS loan_count, coalesce(reports, 0) AS reports, latest_sequence, latest_report, pdo_rank, coalesce(closing_changes, 0) AS closing_changes, coalesce(restructurings, 0) AS restructurings, coalesce(cancellations, 0) AS cancellations, CAST(cancelled AS DECIMAL(38,2)) AS cancelled, coalesce(indicators, 0) AS indicators, coalesce(met, 0) AS met, coalesce(signals, 0) AS signals, coalesce(high_now, 0) AS high_now
FROM projects LEFT JOIN financial USING (project_id) LEFT JOIN r USING (project_id) LEFT JOIN e USING (project_id) LEFT JOIN i USING (project_id) LEFT JOIN s USING (project_id)""",
)
def project_overview(spark: SparkSession, d: str) -> DataFrame:
    s = silver(spark, d)
    kind = lambda k: F.col("event_type") == k
    r = s["reports"].groupBy("project_id").agg(F.count(F.lit(1)).alias("reports"), F.max("isr_sequence").alias("latest_sequence"), F.max("report_date").alias("latest_report"), F.max_by(F.col("digit").cast("long"), "isr_sequence").alias("pdo_rank"))
    e = s["events"].groupBy("project_id").agg(F.count_if(kind("CLOSING_DATE_CHANGE")).alias("closing_changes"), F.count_if(kind("RESTRUCTURING")).alias("restructurings"), F.count_if(kind("CANCELLATION")).alias("cancellations"), F.sum(F.when(kind("CANCELLATION"), F.col("amount"))).cast("decimal(38,2)").alias("cancelled"))
    p = gold.progress_of_results(s["results"]).groupBy("project_id", "indicator_key").agg(F.max_by("target_status", "isr_sequence").alias("now"))
    i = p.groupBy("project_id").agg(F.count(F.lit(1)).alias("indicators"), F.count_if(F.col("now") == "MET").alias("met"))
    g = gold.united(gold.signals(s, INSTRUMENTS)).groupBy("project_id").agg(F.count(F.lit(1)).alias("signals"), F.count_if((F.col("severity") == "HIGH") & (F.col("signal_status") == "CURRENT")).alias("high_now"))
    out = s["projects"].drop("record_id")
    for part in (s["financial"].drop("snapshot_date", "financial_id"), r, e, i, g):
        out = out.join(part, "project_id", "left")
    return out.fillna(0, ["loan_count", "reports", "closing_changes", "restructurings", "cancellations", "indicators", "met", "signals", "high_now"])
