"""Gates: the Gold tables of the stand-in Silver with faults sown into them, and the shop's tables with the faults they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import gate, gold, goldgate
from tallyforge.operators.gate import ERROR, INFO, WARNING, Check, Gate
from tallyforge.plans.gold import _ALL, _SILVER, INSTRUMENTS, silver
from tallyforge.staging import shared_folder, staged

_TOLD = "CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 'PASS' WHEN severity = 'ERROR' THEN 'FAIL' ELSE 'OBSERVED' END AS status"


def _union(checks: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{i}' AS check_id, '{s}' AS severity, ({n}) AS n" for t, i, s, n in checks)


#: Gold with one fault in about 50 to 140 rows of each kind.
_FAULTY = f"""{_SILVER},
ev AS (SELECT record_id, min(project_id) AS project_id, min(event_date) AS event_date FROM events_ GROUP BY record_id),
ids AS (SELECT DISTINCT t, CAST(id AS VARCHAR) AS id FROM (SELECT 'silver.isr_snapshots' AS t, record_id AS id FROM reports WHERE record_id % 89 > 0 UNION ALL SELECT 'silver.project_enrichment', project_id FROM projects UNION ALL SELECT 'silver.project_financial_summary', financial_id FROM financial
  UNION ALL SELECT 'silver.project_events', record_id FROM ev UNION ALL SELECT 'silver.project_results', record_id FROM results WHERE record_id % 83 > 0 UNION ALL SELECT 'silver.appraisal_risks', o_orderkey FROM orders WHERE o_orderkey % 109 > 0)),
p360 AS (SELECT project_id FROM projects WHERE project_id % 113 > 0 UNION ALL SELECT project_id FROM projects WHERE project_id % 127 = 0 UNION ALL SELECT -project_id FROM projects WHERE project_id % 149 = 1),
tl AS (SELECT CASE WHEN record_id % 53 = 0 THEN -1 - record_id ELSE project_id END AS project_id, 'ISR_REPORT' AS event_type, report_date AS event_date, 'EXACT' AS event_date_status, isr_sequence AS event_sequence, CASE WHEN record_id % 59 = 0 THEN isr_sequence + 5 ELSE isr_sequence END AS isr_sequence, 'silver.isr_snapshots' AS source_table, record_id AS source_record_id, record_id % 61 = 0 AS anomaly FROM reports
  UNION ALL SELECT project_id, 'EVENT', CASE WHEN record_id % 67 = 0 THEN DATE '1900-01-01' ELSE event_date END, CASE WHEN event_date IS NULL THEN 'DERIVED_CANDIDATE' ELSE 'EXACT' END, 1000000 + record_id, NULL, CASE WHEN record_id % 71 = 0 THEN 'silver.nothing' ELSE 'silver.project_events' END, record_id, false FROM ev),
pr AS (SELECT project_id, CASE WHEN record_id % 43 = 0 THEN 'merged' ELSE indicator_key END AS canonical, record_id, calculation_status, CASE WHEN record_id % 47 > 0 THEN progress_percentage END AS progress_percentage, target_date FROM progress),
sil AS (SELECT record_id, indicator_key FROM results WHERE record_id % 83 > 0),
cand AS (SELECT DISTINCT indicator_key AS a, CASE WHEN indicator_key = 'click' THEN indicator_key ELSE upper(indicator_key) END AS b FROM results),
rk AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 107 = 0 THEN 'FINDING' ELSE 'FORMAL_RISK_RATING' END AS record_type, 'silver.appraisal_risks' AS source_table FROM orders UNION ALL SELECT record_id, 'ISR_SORT_RATING', 'silver.isr_snapshots' FROM reports),
rs AS (SELECT o_orderkey AS id, 'FORMAL_RISK_RATING' AS framing FROM orders WHERE o_orderkey % 109 > 0),
sg AS (SELECT project_id, rule_id, CASE WHEN project_id % 131 = 0 THEN '0' ELSE rule_version END AS version, CASE WHEN project_id % 137 > 0 THEN string_split(supporting_record_ids, ',') ELSE [] END AS supporting, signal_description || CASE WHEN project_id % 139 = 0 THEN ' It is Likely to fail.' ELSE '' END AS described, effective_sequence % 7 = 0 AS weak, source_table, source_record_id FROM ({_ALL}))"""
_LOST = "NOT EXISTS (SELECT 1 FROM ids WHERE t = source_table AND id = CAST({} AS VARCHAR))"
_GOLD_CHECKS = [
    ("gold.project_360", "P360_ONE_ROW_PER_PROJECT", ERROR, "SELECT count(*) FROM projects ANTI JOIN p360 USING (project_id)) + (SELECT count(*) FROM p360 ANTI JOIN projects USING (project_id)) + (SELECT count(*) - count(DISTINCT project_id) FROM p360"),
    ("gold.project_timeline", "TIMELINE_PROJECTS_RESOLVE", ERROR, "SELECT count(*) FROM tl ANTI JOIN projects USING (project_id)"),
    ("gold.project_timeline", "TIMELINE_SOURCES_RESOLVE", ERROR, f"SELECT count(*) FROM tl WHERE {_LOST.format('source_record_id')}"),
    ("gold.project_timeline", "TIMELINE_NO_DERIVED_DATE_PROMOTED", ERROR, "SELECT count(*) FROM tl JOIN ev ON source_table = 'silver.project_events' AND source_record_id = record_id WHERE tl.event_date IS DISTINCT FROM ev.event_date) + (SELECT count(*) FROM tl WHERE event_date_status = 'DERIVED_CANDIDATE' AND event_date IS NOT NULL"),
    ("gold.project_timeline", "TIMELINE_ISR_SEQUENCE_ORDER", ERROR, "SELECT count(*) FROM (SELECT isr_sequence, lag(isr_sequence) OVER (PARTITION BY project_id ORDER BY event_sequence, source_record_id) AS p FROM tl WHERE event_type = 'ISR_REPORT') WHERE p > isr_sequence"),
    ("gold.project_timeline", "TIMELINE_DATES_PLAUSIBLE", ERROR, "SELECT count(*) FROM tl WHERE event_date < DATE '1944-07-01' OR event_date > DATE '2100-12-31'"),
    ("gold.project_timeline", "NO_AI_INTERPRETATION", ERROR, "SELECT count(*) FROM tl WHERE source_record_id % 101 = 0"),
    ("gold.project_timeline", "ISR_SEQUENCE_DATE_ANOMALY", WARNING, "SELECT count(*) FROM tl WHERE anomaly"),
    ("gold.project_timeline", "TIMELINE_CANDIDATE_DATES", INFO, "SELECT count(*) FROM tl WHERE event_date_status = 'DERIVED_CANDIDATE'"),
    ("gold.result_progress", "RESULTS_ROWS_RESOLVE", ERROR, "SELECT count(*) FROM pr ANTI JOIN sil USING (record_id)) + (SELECT count(*) FROM sil ANTI JOIN pr USING (record_id)"),
    ("gold.result_progress", "RESULTS_IDENTITY_PRESERVED", ERROR, "SELECT count(*) FROM pr JOIN sil USING (record_id) WHERE canonical <> indicator_key"),
    ("gold.result_progress", "RESULTS_PENDING_ALIASES_SEPARATE", ERROR, "SELECT count(*) FROM cand WHERE a = b) + (SELECT count(*) FROM cand WHERE a NOT IN (SELECT canonical FROM pr)) + (SELECT count(*) FROM cand WHERE b NOT IN (SELECT canonical FROM pr)"),
    ("gold.result_progress", "RESULTS_PROGRESS_ONLY_WHEN_VALID", ERROR, "SELECT count(*) FROM pr WHERE (progress_percentage IS NOT NULL) <> (calculation_status = 'OK')"),
    ("gold.result_progress", "NO_AI_INTERPRETATION", ERROR, "SELECT count(*) FROM pr WHERE record_id % 101 = 0"),
    ("gold.result_progress", "RESULTS_NOT_EVALUABLE", INFO, "SELECT count(*) FROM pr WHERE calculation_status <> 'OK'"),
    ("gold.result_progress", "RESULTS_PENDING_ALIAS_REVIEW", INFO, "SELECT count(*) FROM pr WHERE canonical = 'click'"),
    ("gold.result_progress", "SILVER_COMMENTS_LABEL_EXTRACTION", WARNING, "SELECT count(*) FROM sil WHERE record_id % 103 = 0"),
    ("gold.result_progress", "RESULTS_TARGET_DATE_BEFORE_EFFECTIVENESS", WARNING, "SELECT count(*) FROM pr JOIN projects USING (project_id) WHERE target_date < effective_date"),
    ("gold.result_progress", "RESULTS_NEGATIVE_PROGRESS", INFO, "SELECT count(*) FROM pr WHERE progress_percentage < 0"),
    ("gold.risk_register", "RISKS_RESOLVE_AND_KEEP_FRAMING", ERROR, f"SELECT count(*) FROM rk ANTI JOIN rs USING (id) WHERE record_type <> 'ISR_SORT_RATING') + (SELECT count(*) FROM rs WHERE id NOT IN (SELECT id FROM rk WHERE record_type <> 'ISR_SORT_RATING')) + (SELECT count(*) FROM rk JOIN rs USING (id) WHERE record_type <> 'ISR_SORT_RATING' AND record_type <> framing) + (SELECT count(*) FROM rk WHERE {_LOST.format('rk.id')}"),
    ("gold.risk_register", "NO_AI_INTERPRETATION", ERROR, "SELECT count(*) FROM rk WHERE id % 101 = 0"),
    ("gold.attention_signals", "SIGNALS_VALID_RULES", ERROR, "SELECT count(*) FROM sg WHERE version = '0'"),
    ("gold.attention_signals", "SIGNALS_HAVE_EVIDENCE", ERROR, "SELECT count(*) FROM sg WHERE NOT list_contains(supporting, source_record_id)"),
    ("gold.attention_signals", "SIGNALS_EVIDENCE_RESOLVES", ERROR, f"SELECT count(*) FROM sg WHERE {_LOST.format('source_record_id')}) + (SELECT count(*) FROM (SELECT DISTINCT unnest(supporting) AS s FROM sg) WHERE s NOT IN (SELECT id FROM ids)"),
    ("gold.attention_signals", "SIGNALS_NEUTRAL_WORDING", ERROR, "SELECT count(*) FROM sg WHERE regexp_matches(lower(described), '\\b(will fail|failure probability|probability of|likely to fail|predict)')"),
    ("gold.attention_signals", "NO_AI_INTERPRETATION", ERROR, "SELECT count(*) FROM sg WHERE project_id % 101 = 0"),
    ("gold.attention_signals", "SIGNALS_ON_NON_EXACT_EVIDENCE", WARNING, "SELECT count(*) FROM sg WHERE weak"),
    ("silver.data_quality_observations", "SILVER_QUALITY_CARRIED", INFO, "SELECT count(*) FROM orders WHERE o_totalprice > 300000"),
]


def _faulty(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Silver and Gold of the stand-ins, with faults by remainders of their ids."""
    folder = shared_folder(spark)
    c, s = F.col, silver(spark, d, folder)
    text = lambda name: c(name).cast("string")
    orders = table(spark, d, "orders")
    reports = s["reports"]
    events = staged(s["events"].groupBy("record_id").agg(F.min("project_id").alias("project_id"), F.min("event_date").alias("event_date")), folder, "events")
    by = lambda i: F.when(c(i) % 101 == 0, "AI_INTERPRETATION").otherwise("SOURCE_FACT").alias("provenance_class")
    progress = s["progress"]
    key = c("record_id")
    canonical = F.when(key % 43 == 0, "merged").otherwise(c("indicator_key"))
    appraisal = orders.select(c("o_orderkey").alias("id"), F.lit("FORMAL_RISK_RATING").alias("framing"))
    one = s["projects"].select("project_id")
    below = {
        "projects": s["projects"].select("project_id", "effective_date"),
        "project_enrichment": s["projects"].select(text("project_id").alias("record_id")),
        "project_financial_summary": s["financial"].select(text("financial_id").alias("record_id")),
        "isr_snapshots": reports.filter(key % 89 > 0).select(text("record_id").alias("record_id")),
        "project_events": events.select(text("record_id").alias("record_id"), "event_date"),
        "project_results": s["results"].filter(key % 83 > 0).select(text("record_id").alias("record_id"), "indicator_key", F.when(key % 103 == 0, " Comments on achieving targets").alias("comments")),
        "appraisal_risks": appraisal.filter(c("id") % 109 > 0).select(text("id").alias("record_id"), "framing"),
        "indicator_match_candidates": s["results"].select(c("indicator_key").alias("indicator_key_a"), F.when(c("indicator_key") == "click", c("indicator_key")).otherwise(F.upper("indicator_key")).alias("indicator_key_b"), F.lit("PENDING_REVIEW").alias("review_status")).distinct(),
        "data_quality_observations": orders.filter("o_totalprice > 300000").select("o_orderkey"),
    }
    signals = gold.united(gold.signals(s, INSTRUMENTS))
    above = {
        "project_360": one.filter(c("project_id") % 113 > 0).unionByName(one.filter(c("project_id") % 127 == 0)).unionByName(one.filter(c("project_id") % 149 == 1).select((-c("project_id")).alias("project_id"))),
        "project_timeline": reports.select(
            F.when(key % 53 == 0, -1 - key).otherwise(c("project_id")).alias("project_id"), F.lit("ISR_REPORT").alias("event_type"), c("report_date").alias("event_date"), F.lit("EXACT").alias("event_date_status"), c("isr_sequence").alias("event_sequence"),
            F.when(key % 59 == 0, c("isr_sequence") + 5).otherwise(c("isr_sequence")).alias("isr_sequence"), F.lit("silver.isr_snapshots").alias("source_table"), text("record_id").alias("source_record_id"), (key % 61 == 0).alias("date_sequence_anomaly"), by("record_id"),
        ).unionByName(events.select(
            "project_id", F.lit("EVENT").alias("event_type"), F.when(key % 67 == 0, F.lit("1900-01-01").cast("date")).otherwise(c("event_date")).alias("event_date"), F.when(c("event_date").isNull(), "DERIVED_CANDIDATE").otherwise("EXACT").alias("event_date_status"), (key + 1000000).alias("event_sequence"),
            F.lit(None).cast("long").alias("isr_sequence"), F.when(key % 71 == 0, "silver.nothing").otherwise("silver.project_events").alias("source_table"), text("record_id").alias("source_record_id"), F.lit(False).alias("date_sequence_anomaly"), by("record_id"),
        )),
        "result_progress": progress.select("project_id", canonical.alias("canonical_indicator_id"), text("record_id").alias("source_record_id"), "calculation_status", F.when(key % 47 > 0, c("progress_percentage")).alias("progress_percentage"), F.when(canonical == "click", "PENDING_ALIAS_REVIEW").alias("identity_review_status"), c("target_date").alias("target_date_parsed"), by("record_id")),
        "risk_register": appraisal.select(text("id").alias("source_record_id"), F.when(c("id") % 107 == 0, "FINDING").otherwise(c("framing")).alias("record_type"), F.lit("silver.appraisal_risks").alias("source_table"), by("id")).unionByName(reports.select(text("record_id").alias("source_record_id"), F.lit("ISR_SORT_RATING").alias("record_type"), F.lit("silver.isr_snapshots").alias("source_table"), by("record_id"))),
        "attention_signals": staged(signals.select(
            "rule_id", F.when(c("project_id") % 131 == 0, "0").otherwise(c("rule_version")).alias("rule_version"), F.when(c("project_id") % 137 > 0, c("supporting_record_ids")).otherwise(F.array().cast("array<string>")).alias("supporting_record_ids"), F.concat("signal_description", F.when(c("project_id") % 139 == 0, " It is Likely to fail.").otherwise("")).alias("signal_description"),
            F.when(c("effective_sequence") % 7 == 0, "AMBIGUOUS").otherwise("EXACT").alias("evidence_status"), "source_table", "source_record_id", by("project_id"),
        ), folder, "signals"),
    }
    return below, above


@query("gold_gate", f"WITH {_FAULTY}, u AS ({_union(_GOLD_CHECKS)}) SELECT table_name, check_id, severity, {_TOLD} FROM u")
def gold_gate(spark: SparkSession, d: str) -> DataFrame:
    """What the gate counts of faulty Gold: 16 invariants and 9 observations, one pass over each table."""
    below, above = _faulty(spark, d)
    return gate.counts(goldgate.gates(below, above, {n: r.version for n, r in gold.RULES.items()}))


_SHOP_CHECKS = [
    ("sales", "REPEATED_ID", ERROR, "SELECT count(*) - count(DISTINCT sale_id) FROM sales WHERE sale_id IS NOT NULL"),
    ("sales", "UNKNOWN_CLIENT", ERROR, "SELECT count(*) FROM sales WHERE NOT EXISTS (SELECT 1 FROM clients c WHERE c.client_id = sales.client_id)"),
    ("sales", "NEGATIVE_TOTAL", ERROR, "SELECT count(*) FROM sales WHERE total < 0"),
    ("sales", "SOLD_AT_MISSING", WARNING, "SELECT count(*) FROM sales WHERE sold_at IS NULL"),
    ("sales", "ARRIVED_A_DAY_LATE", INFO, "SELECT count(*) FROM sales WHERE arrived_at > sold_at + INTERVAL 1 DAY"),
    ("sales", "ARRIVED_BEFORE_SOLD", WARNING, "SELECT count(*) FROM sales WHERE arrived_at < sold_at"),
    ("sale_lines", "REPEATED_LINE", WARNING, "SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM sale_lines GROUP BY sale_id, line_no)"),
    ("sale_lines", "UNKNOWN_SALE", ERROR, "SELECT count(*) FROM sale_lines WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.sale_id = sale_lines.sale_id)"),
    ("sale_lines", "UNKNOWN_ITEM", ERROR, "SELECT count(*) FROM sale_lines WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.item_id = sale_lines.item_id)"),
    ("sale_lines", "UNKNOWN_VENDOR", ERROR, "SELECT count(*) FROM sale_lines WHERE NOT EXISTS (SELECT 1 FROM vendors v WHERE v.vendor_id = sale_lines.vendor_id)"),
    ("sale_lines", "QUANTITY_NOT_POSITIVE", ERROR, "SELECT count(*) FROM sale_lines WHERE quantity <= 0"),
    ("sale_lines", "DISCOUNT_OUTSIDE", ERROR, "SELECT count(*) FROM sale_lines WHERE discount < 0 OR discount > 1"),
    ("client_changes", "REPEATED_ID", ERROR, "SELECT count(*) - count(DISTINCT change_id) FROM client_changes WHERE change_id IS NOT NULL"),
    ("client_changes", "UNKNOWN_CLIENT", ERROR, "SELECT count(*) FROM client_changes WHERE NOT EXISTS (SELECT 1 FROM clients c WHERE c.client_id = client_changes.client_id)"),
    ("client_changes", "VALID_AT_MISSING", WARNING, "SELECT count(*) FROM client_changes WHERE valid_at IS NULL"),
    ("client_changes", "FOREIGN_OPERATION", ERROR, "SELECT count(*) FROM client_changes WHERE op NOT IN ('I', 'U', 'D')"),
    ("clients", "UNKNOWN_MASTER", ERROR, "SELECT count(*) FROM clients WHERE NOT EXISTS (SELECT 1 FROM clients m WHERE m.client_id = clients.master_id)"),
    ("clients", "UNKNOWN_NATION", WARNING, "SELECT count(*) FROM clients WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = nation_id)"),
    ("clients", "EMAIL_BLANK", WARNING, "SELECT count(*) FROM clients WHERE coalesce(trim(email), '') = ''"),
    ("clicks", "REPEATED_ID", ERROR, "SELECT count(*) - count(DISTINCT click_id) FROM clicks WHERE click_id IS NOT NULL"),
    ("clicks", "UNKNOWN_CLIENT", WARNING, "SELECT count(*) FROM clicks WHERE NOT EXISTS (SELECT 1 FROM clients c WHERE c.client_id = clicks.client_id)"),
    ("clicks", "PROPS_BLANK", INFO, "SELECT count(*) FROM clicks WHERE coalesce(trim(props), '') = ''"),
    ("stamps", "RAW_BLANK", WARNING, "SELECT count(*) FROM stamps WHERE coalesce(trim(raw), '') = ''"),
]


@query("shop_gate", f"WITH u AS ({_union(_SHOP_CHECKS)}) SELECT table_name, check_id, severity, {_TOLD} FROM u")
def shop_gate(spark: SparkSession, d: str) -> DataFrame:
    """The shop's tables as they come: references, ranges, times and repeated ids, each table's rows in one aggregation."""
    c = F.col
    t = {n: table(spark, d, n) for n in ("sales", "sale_lines", "client_changes", "clients", "clicks", "stamps", "items", "vendors", "nation")}
    blank = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    twice = lambda name, check, severity, *keys: Gate(gate.repeated(t[name].dropna(subset=list(keys)) if len(keys) == 1 else t[name], *keys), (Check(check, severity, c("extra")),))
    client = lambda name: gate.resolved(t[name], {"client_id": "client_id"}, t["clients"], "__client")
    lines = t["sale_lines"]
    for key, other in (("sale_id", "sales"), ("item_id", "items"), ("vendor_id", "vendors")):
        lines = gate.resolved(lines, {key: key}, t[other], f"__{other}")
    clients = gate.resolved(gate.resolved(t["clients"], {"master_id": "client_id"}, t["clients"], "__master"), {"nation_id": "n_nationkey"}, t["nation"], "__nation")
    return gate.counts(
        {
            "sales": [
                twice("sales", "REPEATED_ID", ERROR, "sale_id"),
                Gate(client("sales"), (Check("UNKNOWN_CLIENT", ERROR, ~c("__client")), Check("NEGATIVE_TOTAL", ERROR, c("total") < 0), Check("SOLD_AT_MISSING", WARNING, c("sold_at").isNull()), Check("ARRIVED_A_DAY_LATE", INFO, c("arrived_at") > c("sold_at") + F.expr("INTERVAL 1 DAY")), Check("ARRIVED_BEFORE_SOLD", WARNING, c("arrived_at") < c("sold_at")))),
            ],
            "sale_lines": [
                twice("sale_lines", "REPEATED_LINE", WARNING, "sale_id", "line_no"),
                Gate(lines, (Check("UNKNOWN_SALE", ERROR, ~c("__sales")), Check("UNKNOWN_ITEM", ERROR, ~c("__items")), Check("UNKNOWN_VENDOR", ERROR, ~c("__vendors")), Check("QUANTITY_NOT_POSITIVE", ERROR, c("quantity") <= 0), Check("DISCOUNT_OUTSIDE", ERROR, ~c("discount").between(0, 1)))),
            ],
            "client_changes": [
                twice("client_changes", "REPEATED_ID", ERROR, "change_id"),
                Gate(client("client_changes"), (Check("UNKNOWN_CLIENT", ERROR, ~c("__client")), Check("VALID_AT_MISSING", WARNING, c("valid_at").isNull()), Check("FOREIGN_OPERATION", ERROR, ~c("op").isin("I", "U", "D")))),
            ],
            "clients": [Gate(clients, (Check("UNKNOWN_MASTER", ERROR, ~c("__master")), Check("UNKNOWN_NATION", WARNING, ~c("__nation")), Check("EMAIL_BLANK", WARNING, blank("email"))))],
            "clicks": [
                twice("clicks", "REPEATED_ID", ERROR, "click_id"),
                Gate(client("clicks"), (Check("UNKNOWN_CLIENT", WARNING, ~c("__client")), Check("PROPS_BLANK", INFO, blank("props")))),
            ],
            "stamps": [Gate(t["stamps"], (Check("RAW_BLANK", WARNING, blank("raw")),))],
        }
    )
