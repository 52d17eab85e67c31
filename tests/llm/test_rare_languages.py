"""Operator 9: a rare language is a class."""

from __future__ import annotations

from tallyforge.llm import langid


def test_rare_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    ids = [i for i in range(9000) if not langid.crc_held_out(i)]
    rows = [(i, f"abc def {i}", "a") for i in ids[:-4]] + [(i, f"xyz uvw {i}", "b") for i in ids[-4:-1]] + [(ids[-1], "", "c")]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)
    assert net.classes == ["a", "b"]
