"""The gate: each invariant has a fixture that fails it alone, observations never close it, and a closed gate returns nothing."""

from __future__ import annotations

import datetime

import pytest

from tallyforge.operators import gate, goldgate
from tallyforge.staging import shared_folder

RULES = {"RATING_DOWNGRADE": "1"}
DAY = datetime.date(2020, 1, 1)
SILVER = {
    "projects": ("project_id string, effective_date date", [("P1", DAY), ("P2", DAY)]),
    "isr_snapshots": ("record_id string", [("i1",), ("i2",)]),
    "project_events": ("record_id string, event_date date", [("e1", DAY), ("e2", None)]),
    "project_results": ("record_id string, indicator_key string, comments string", [("r1", "k1", None), ("r2", "k2", "fine")]),
    "appraisal_risks": ("record_id string, framing string", [("a1", "FINDING")]),
    "indicator_match_candidates": ("indicator_key_a string, indicator_key_b string, review_status string", [("k1", "k2", "PENDING_REVIEW"), ("k1", "gone", "REJECTED")]),
    "data_quality_observations": ("severity string", [("INFO",)]),
}
GOLD = {
    "project_360": ("project_id string", [("P1",), ("P2",)]),
    "project_timeline": (
        "project_id string, event_type string, event_date date, event_date_status string, event_sequence long, isr_sequence long, date_sequence_anomaly boolean, source_table string, source_record_id string, provenance_class string",
        [
            ("P1", "ISR_REPORT", DAY, "EXACT", 1, 1, False, "silver.isr_snapshots", "i1", "FACT"),
            ("P1", "ISR_REPORT", DAY, "EXACT", 2, 2, False, "silver.isr_snapshots", "i2", "FACT"),
            ("P2", "EVENT", DAY, "EXACT", 1, None, None, "silver.project_events", "e1", "FACT"),
            ("P2", "EVENT", None, "DERIVED_CANDIDATE", 2, None, None, "silver.project_events", "e2", "FACT"),
        ],
    ),
    "result_progress": (
        "project_id string, canonical_indicator_id string, calculation_status string, progress_percentage double, identity_review_status string, target_date_parsed date, source_record_id string, provenance_class string",
        [("P1", "k1", "OK", 5.0, None, DAY, "r1", "FACT"), ("P1", "k2", "MISSING_TARGET", None, None, None, "r2", "FACT")],
    ),
    "risk_register": ("record_type string, source_table string, source_record_id string, provenance_class string", [("FINDING", "silver.appraisal_risks", "a1", "FACT"), ("ISR_SORT_RATING", "silver.isr_snapshots", "i1", "FACT")]),
    "attention_signals": (
        "rule_id string, rule_version string, supporting_record_ids array<string>, signal_description string, evidence_status string, source_table string, source_record_id string, provenance_class string",
        [("RATING_DOWNGRADE", "1", ["i1", "i2"], "Rated lower.", "EXACT", "silver.isr_snapshots", "i2", "FACT")],
    ),
}


def frames(spark, spec, changed=None):
    return {n: spark.createDataFrame((changed or {}).get(n, rows), schema) for n, (schema, rows) in spec.items()}


def edit(table, row, **values):
    """The table's rows with one row's columns changed."""
    schema, rows = (GOLD | SILVER)[table]
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    return {table: [tuple(values.get(n, v) for n, v in zip(names, r)) if i == row else r for i, r in enumerate(rows)]}


LATE, EARLY = datetime.date(2200, 1, 1), datetime.date(1900, 1, 1)
#: A fault and how often its check counts it; nothing else of the table fails.
FAULTS = [
    ("P360_ONE_ROW_PER_PROJECT", {"project_360": [("P1",), ("P1",), ("P3",)]}, 3),
    ("TIMELINE_PROJECTS_RESOLVE", edit("project_timeline", 2, project_id="P9"), 1),
    ("TIMELINE_PROJECTS_RESOLVE", edit("project_timeline", 2, project_id=None), 1),
    ("TIMELINE_SOURCES_RESOLVE", edit("project_timeline", 0, source_record_id="e1"), 1),
    ("TIMELINE_NO_DERIVED_DATE_PROMOTED", edit("project_timeline", 3, event_date=DAY), 2),
    ("TIMELINE_NO_DERIVED_DATE_PROMOTED", edit("project_timeline", 2, event_date=None), 1),
    ("TIMELINE_ISR_SEQUENCE_ORDER", edit("project_timeline", 0, isr_sequence=3), 1),
    ("TIMELINE_DATES_PLAUSIBLE", edit("project_timeline", 0, event_date=LATE), 1),
    ("TIMELINE_DATES_PLAUSIBLE", edit("project_timeline", 1, event_date=EARLY), 1),
    ("RESULTS_ROWS_RESOLVE", edit("result_progress", 1, source_record_id="r9"), 2),
    ("RESULTS_IDENTITY_PRESERVED", {"result_progress": [("P1", k, *r[2:]) for k, r in zip(("k2", "k1"), GOLD["result_progress"][1])]}, 2),
    ("RESULTS_PENDING_ALIASES_SEPARATE", {"indicator_match_candidates": [("k1", "k1", "PENDING_REVIEW"), ("k3", "k2", "PENDING_REVIEW")]}, 2),
    ("RESULTS_PROGRESS_ONLY_WHEN_VALID", edit("result_progress", 0, progress_percentage=None), 1),
    ("RESULTS_PROGRESS_ONLY_WHEN_VALID", edit("result_progress", 1, progress_percentage=1.0), 1),
    ("RISKS_RESOLVE_AND_KEEP_FRAMING", edit("risk_register", 0, record_type="FORMAL_RISK_RATING"), 1),
    ("RISKS_RESOLVE_AND_KEEP_FRAMING", edit("risk_register", 1, source_record_id="i9"), 1),
    ("RISKS_RESOLVE_AND_KEEP_FRAMING", {"risk_register": GOLD["risk_register"][1][1:]}, 1),
    ("SIGNALS_VALID_RULES", edit("attention_signals", 0, rule_version="2"), 1),
    ("SIGNALS_VALID_RULES", edit("attention_signals", 0, rule_id=None), 1),
    ("SIGNALS_HAVE_EVIDENCE", edit("attention_signals", 0, supporting_record_ids=[]), 1),
    ("SIGNALS_HAVE_EVIDENCE", edit("attention_signals", 0, supporting_record_ids=["i1"]), 1),
    ("SIGNALS_EVIDENCE_RESOLVES", edit("attention_signals", 0, supporting_record_ids=["i2", "x"]), 1),
    ("SIGNALS_NEUTRAL_WORDING", edit("attention_signals", 0, signal_description="It will FAIL soon."), 1),
    *(("NO_AI_INTERPRETATION", edit(t, 0, provenance_class="AI_INTERPRETATION"), 1) for t in ("project_timeline", "result_progress", "risk_register", "attention_signals")),
]


def test_every_invariant_has_its_fault(spark):
    for check, changed, n in FAULTS:
        table = "result_progress" if "indicator_match_candidates" in changed else next(iter(changed))
        parts = goldgate.gates(frames(spark, SILVER, changed), frames(spark, GOLD, changed), RULES)[f"gold.{table}"]
        failed = gate.counts({table: parts}).filter("status = 'FAIL'").collect()
        assert [(r.check_id, r.n) for r in failed] == [(check, n)], changed
    assert len({f[0] for f in FAULTS}) == 16


def test_observations_are_told_and_close_nothing(spark):
    changed = edit("result_progress", 0, progress_percentage=-5.0, identity_review_status="PENDING_ALIAS_REVIEW", target_date_parsed=EARLY)
    changed |= edit("project_timeline", 1, date_sequence_anomaly=True) | edit("attention_signals", 0, evidence_status="AMBIGUOUS") | edit("project_results", 1, comments=" Comments on achieving Targets ")
    s, g = frames(spark, SILVER, changed), frames(spark, GOLD, changed)
    told = {r.check_id: (r.n, r.status) for r in gate.counts(goldgate.gates(s, g, RULES)).filter("severity <> 'ERROR'").collect()}
    assert len(told) == 9 and set(told.values()) == {(1, "OBSERVED")}
    out = goldgate.published(s, g, RULES, shared_folder(spark))
    assert {n: sorted(map(str, df.collect())) for n, df in out.items()} == {n: sorted(map(str, df.collect())) for n, df in g.items()}


@pytest.mark.parametrize("check", ["TIMELINE_DATES_PLAUSIBLE", "TIMELINE_ISR_SEQUENCE_ORDER", "RESULTS_ROWS_RESOLVE", "SIGNALS_NEUTRAL_WORDING", "P360_ONE_ROW_PER_PROJECT"])
def test_a_failed_invariant_stops_the_write(spark, check):
    _, changed, n = next(f for f in FAULTS if f[0] == check)
    with pytest.raises(gate.GateClosed) as e:
        goldgate.published(frames(spark, SILVER, changed), frames(spark, GOLD, changed), RULES, shared_folder(spark))
    assert e.value.counts == {check: n}


def test_empty_tables_pass(spark):
    none = {n: [] for n in SILVER | GOLD}
    s, g = frames(spark, SILVER, none), frames(spark, GOLD, none)
    assert [r.n for r in gate.counts(goldgate.gates(s, g, RULES)).collect()] == [0] * 28
    out = goldgate.published(s, g, {}, shared_folder(spark))
    assert all(df.count() == 0 for df in out.values())


def test_the_row_before_over_many_spans(spark, monkeypatch):
    monkeypatch.setattr(gate, "SPAN", 7)
    places = [p for p in range(200) if p % 31 and not 40 <= p < 70]
    rows = [("hot" if p % 3 else None, p, None if p % 11 == 0 else (p * 37) % 101) for p in places]
    got = gate.before(spark.createDataFrame(rows, "g string, p long, v long"), "g", "p", "v", "was").collect()
    last, want = {}, {}
    for g, p, v in sorted(rows, key=lambda r: r[1]):
        want[p], last[g] = last.get(g), v
    assert {r.p: r.was for r in got} == want


def test_staged_silver_is_the_same(spark, tmp_path):
    """What the gate's Gold is made of is made once: staged frames have the rows of those that are not."""
    from tallyforge.plans import gold as plans

    lazy, kept = plans.silver(spark, "/root/testdata/sf0.001"), plans.silver(spark, "/root/testdata/sf0.001", f"file://{tmp_path}/kept")
    for name, df in kept.items():
        other = goldgate_progress(lazy) if name == "progress" else lazy[name]
        other = other.select(*df.columns)
        assert df.count() == other.count() and not df.exceptAll(other).take(1), name
        assert name not in ("progress", "reports") or "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def goldgate_progress(frames):
    from tallyforge.operators import gold

    return gold.progress_of_results(frames["results"])
