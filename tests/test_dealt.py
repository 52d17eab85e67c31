"""What a task sorts of reports and attempts doesn't grow with the tables: tasks follow the rows, and rows stay in place."""

from __future__ import annotations

import pytest

from tallyforge import catalog, staging
from tallyforge.operators import evaluation

DATA = "/root/testdata/sf0.001"


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in line and "BroadcastExchange" not in line]


@pytest.mark.parametrize("name", ["result_blocks", "risk_category_ratings", "result_rows", "risk_tables", "report_narratives"])
def test_reports_are_shuffled_as_orders_only(spark, monkeypatch, name):
    monkeypatch.setattr(staging.dealt, "__kwdefaults__", {"rows": 100})
    n = -(-spark.read.parquet(f"{DATA}/orders.parquet").count() // 100)
    found = exchanges(catalog.queries()[name](spark, DATA))
    assert found and all(f", {n}), REPARTITION_BY_NUM" in line for line in found), found


def test_attempts(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "ATTEMPTS", 500)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    (line,) = exchanges(catalog.queries()["latest_attempts"](spark, DATA))
    assert f", {n}), REPARTITION_BY_NUM" in line
