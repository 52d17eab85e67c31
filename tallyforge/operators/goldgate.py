"""What must hold of the Gold tables before they are written, and what is told of them: 16 invariants, 9 observations.

Silver frames are named as their tables and have record_id, unique in its table. Nothing is remembered of earlier runs: Gold
stands against Silver and against the rules that are on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import gate
from tallyforge.operators.gate import ERROR, INFO, WARNING, Check, Gate

#: The first and last possible date, the label that stands for a comment, words that foretell, evidence to trust.
FIRST_DAY, LAST_DAY = "1944-07-01", "2100-12-31"
COMMENTS_LABEL = "comments on achieving targets"
FORETELLING = ("will fail", "failure probability", "probability of", "likely to fail", "predict")
TRUSTED = ("EXACT", "NORMALIZED", "DERIVED_FROM_EXPLICIT_SOURCE")
ISR, SORT, CANDIDATE = "ISR_REPORT", "ISR_SORT_RATING", "DERIVED_CANDIDATE"


def _interpreted() -> Check:
    return Check("NO_AI_INTERPRETATION", ERROR, F.col("provenance_class") == "AI_INTERPRETATION")


def _source(rows: DataFrame, ids: DataFrame) -> DataFrame:
    # the id first: few tables' names begin alike, and a sort that begins with them compares whole rows
    return gate.resolved(rows, {"source_record_id": "id", "source_table": "t"}, ids, "__source")


def gates(silver: dict[str, DataFrame], gold: dict[str, DataFrame], rules: dict[str, str]) -> dict[str, list[Gate]]:
    """The gates of each Gold table. ``rules`` maps the enabled rules to their versions.

    Gold: project_360 (project_id), project_timeline (project_id, event_type, event_date, event_date_status, event_sequence,
    isr_sequence, date_sequence_anomaly), result_progress (project_id, canonical_indicator_id, calculation_status,
    progress_percentage, identity_review_status, target_date_parsed), risk_register (record_type), attention_signals (rule_id,
    rule_version, supporting_record_ids, signal_description, evidence_status); all but the first have source_record_id
    and provenance_class, all but results source_table. Silver: projects (project_id, effective_date), project_events
    (event_date), project_results (indicator_key, comments), appraisal_risks (framing), indicator_match_candidates
    (indicator_key_a, indicator_key_b, review_status), data_quality_observations, and whatever else sources name.
    Record ids are strings on both sides; further columns are carried.
    """
    c = F.col
    inside = [n for n, df in silver.items() if "record_id" in df.columns]
    ids = reduce(DataFrame.unionByName, (silver[n].select(F.lit(f"silver.{n}").alias("t"), c("record_id").alias("id")) for n in inside)).distinct()
    projects = silver["projects"]
    out = {}

    p = gold["project_360"]
    out["gold.project_360"] = [
        Gate(gate.covered(p, "project_id", projects, "project_id"), (Check("P360_ONE_ROW_PER_PROJECT", ERROR, gate.uncovered()),)),
        Gate(p, (), tuple(p.columns)),
    ]

    t = gold["project_timeline"]
    of_events = silver["project_events"].select(F.lit("silver.project_events").alias("__t"), c("record_id").alias("__id"), c("event_date").alias("__stated"), F.lit(True).alias("__event"))
    rows = _source(gate.resolved(t, {"project_id": "project_id"}, projects, "__project"), ids)
    rows = rows.join(of_events, (c("source_record_id") == c("__id")) & (c("source_table") == c("__t")), "left")
    moved = c("__event") & ~c("event_date").eqNullSafe(c("__stated"))
    candidate = c("event_date_status") == CANDIDATE
    promoted = F.coalesce(moved.cast("int"), F.lit(0)) + F.coalesce((candidate & c("event_date").isNotNull()).cast("int"), F.lit(0))
    reports = gate.before(t.filter(c("event_type") == ISR).select("project_id", "event_sequence", "isr_sequence"), "project_id", "event_sequence", "isr_sequence", "__before")
    out["gold.project_timeline"] = [
        Gate(
            rows,
            (
                Check("TIMELINE_PROJECTS_RESOLVE", ERROR, ~c("__project")),
                Check("TIMELINE_SOURCES_RESOLVE", ERROR, ~c("__source")),
                Check("TIMELINE_NO_DERIVED_DATE_PROMOTED", ERROR, promoted),
                Check("TIMELINE_DATES_PLAUSIBLE", ERROR, ~c("event_date").between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))),
                _interpreted(),
                Check("ISR_SEQUENCE_DATE_ANOMALY", WARNING, c("date_sequence_anomaly")),
                Check("TIMELINE_CANDIDATE_DATES", INFO, candidate),
            ),
            tuple(t.columns),
        ),
        Gate(reports, (Check("TIMELINE_ISR_SEQUENCE_ORDER", ERROR, c("__before") > c("isr_sequence")),)),
    ]

    g = gold["result_progress"]
    of_results = silver["project_results"].select(c("record_id").alias("__id"), c("indicator_key").alias("__key"), c("comments").alias("__comments"), F.lit(True).alias("__silver"))
    begun = projects.select(c("project_id").alias("__p"), c("effective_date").alias("__begun"))
    rows = g.withColumn("__gold", F.lit(True)).join(of_results, c("source_record_id") == c("__id"), "full").join(begun, c("project_id") == c("__p"), "left")
    ok = c("calculation_status") == "OK"
    out["gold.result_progress"] = [
        Gate(
            rows,
            (
                Check("RESULTS_ROWS_RESOLVE", ERROR, c("__gold").isNull() | c("__silver").isNull()),
                Check("RESULTS_IDENTITY_PRESERVED", ERROR, c("canonical_indicator_id") != c("__key")),
                Check("RESULTS_PROGRESS_ONLY_WHEN_VALID", ERROR, c("progress_percentage").isNotNull() != ok),
                _interpreted(),
                Check("RESULTS_NOT_EVALUABLE", INFO, ~ok),
                Check("RESULTS_PENDING_ALIAS_REVIEW", INFO, c("identity_review_status") == "PENDING_ALIAS_REVIEW"),
                Check("SILVER_COMMENTS_LABEL_EXTRACTION", WARNING, F.lower(F.trim("__comments")) == COMMENTS_LABEL),
                Check("RESULTS_TARGET_DATE_BEFORE_EFFECTIVENESS", WARNING, c("target_date_parsed") < c("__begun")),
                Check("RESULTS_NEGATIVE_PROGRESS", INFO, c("progress_percentage") < 0),
            ),
            tuple(g.columns),
            c("__gold"),
        ),
        Gate(
            gate.resolved(
                gate.resolved(silver["indicator_match_candidates"].filter("review_status = 'PENDING_REVIEW'"), {"indicator_key_a": "canonical_indicator_id"}, g, "__a"),
                {"indicator_key_b": "canonical_indicator_id"}, g, "__b",
            ),
            (Check("RESULTS_PENDING_ALIASES_SEPARATE", ERROR, F.coalesce((c("indicator_key_a") == c("indicator_key_b")).cast("int"), F.lit(0)) + (~c("__a")).cast("int") + (~c("__b")).cast("int")),),
        ),
    ]

    r = gold["risk_register"]
    of_risks = silver["appraisal_risks"].select(c("record_id").alias("__id"), c("framing").alias("__framing"), F.lit(True).alias("__silver"))
    # sort ratings have no partner: a second key keeps them apart, spread by their own ids
    rows = _source(r, ids).withColumn("__gold", F.lit(True)).withColumn("__appraisal", c("record_type") != SORT)
    rows = rows.join(of_risks, (c("source_record_id") == c("__id")) & (c("__appraisal") == c("__silver")), "full")
    unkept = [c("__gold").isNull(), c("__appraisal") & c("__silver").isNull(), c("record_type") != c("__framing"), ~c("__source")]
    out["gold.risk_register"] = [
        Gate(
            rows,
            (Check("RISKS_RESOLVE_AND_KEEP_FRAMING", ERROR, reduce(lambda a, b: a + b, (F.coalesce(u.cast("int"), F.lit(0)) for u in unkept))), _interpreted()),
            tuple(r.columns),
            c("__gold"),
        )
    ]

    s = gold["attention_signals"]
    named = F.array(*(F.lit(f"{k}@v{v}") for k, v in rules.items())) if rules else F.array().cast("array<string>")
    supporting = s.select(F.explode("supporting_record_ids").alias("id")).distinct()
    out["gold.attention_signals"] = [
        Gate(
            _source(s, ids),
            (
                Check("SIGNALS_VALID_RULES", ERROR, ~F.coalesce(F.array_contains(named, F.concat_ws("@v", "rule_id", "rule_version")), F.lit(False))),
                Check("SIGNALS_HAVE_EVIDENCE", ERROR, ~F.coalesce(F.array_contains("supporting_record_ids", c("source_record_id")), F.lit(False))),
                Check("SIGNALS_EVIDENCE_RESOLVES", ERROR, ~c("__source")),
                Check("SIGNALS_NEUTRAL_WORDING", ERROR, F.lower("signal_description").rlike(r"\b(" + "|".join(FORETELLING) + ")")),
                _interpreted(),
                Check("SIGNALS_ON_NON_EXACT_EVIDENCE", WARNING, ~c("evidence_status").isin(*TRUSTED)),
            ),
            tuple(s.columns),
        ),
        Gate(gate.resolved(supporting, {"id": "id"}, ids, "__known"), (Check("SIGNALS_EVIDENCE_RESOLVES", ERROR, ~c("__known")),)),
    ]
    out["silver.data_quality_observations"] = [Gate(silver["data_quality_observations"], (Check("SILVER_QUALITY_CARRIED", INFO, F.lit(1)),))]
    return out


def published(silver: dict[str, DataFrame], gold: dict[str, DataFrame], rules: dict[str, str], folder: str) -> dict[str, DataFrame]:
    """All Gold tables, written and read again, or GateClosed at the first whose invariants fail: then none is returned."""
    return {name.split(".")[1]: gate.written(name, parts, folder) for name, parts in gates(silver, gold, rules).items() if name.startswith("gold.")}
