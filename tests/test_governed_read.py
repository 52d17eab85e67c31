"""Governed reads keep what the period asks for and fail beyond 2,000 rows."""

from __future__ import annotations

import datetime

import pytest

from tallyforge.operators import reads
from tallyforge.plans import governance


def _hot(spark, old, new):
    day = lambda y, i: datetime.date(y, 1, 1) + datetime.timedelta(days=i % 300)
    rows = [(i, 7, day(1992, i), 1, 5000) for i in range(old)] + [(old + i, 7, day(1995, i), 1, 5000) for i in range(new)]
    return spark.createDataFrame(rows, "record_id long, entity long, day date, rating int, amount int")


def test_recent_rows_of_a_hot_entity(spark, monkeypatch):
    monkeypatch.setattr(governance, "reports", lambda spark, d: _hot(spark, 2500, 10))
    rows = governance.governed_read(spark, "").collect()
    assert [r["record_id"] for r in rows] == list(range(2500, 2510))


def test_too_many_rows_fail(spark, monkeypatch):
    monkeypatch.setattr(governance, "reports", lambda spark, d: _hot(spark, 0, reads.MOST_ROWS))
    assert governance.governed_read(spark, "").count() == reads.MOST_ROWS
    monkeypatch.setattr(governance, "reports", lambda spark, d: _hot(spark, 0, reads.MOST_ROWS + 1))
    with pytest.raises(Exception, match="more than 2000 rows"):
        governance.governed_read(spark, "").count()
    with pytest.raises(reads.ScopeError):
        reads.collected(governance.governed_read(spark, ""))
