"""A block's lines are gone through once: what the machine and the carried places need stands in one pass, and rows go with it."""

from __future__ import annotations

from tallyforge.operators import machines, prefix


def test_blocks_of_lines_in_one_pass(spark, monkeypatch):
    names, keep = [], prefix.staged
    monkeypatch.setattr(prefix, "staged", lambda df, folder, name: names.append(name) or keep(df, folder, name))
    texts = ["Results", "# a", "b", "Value 1 2 3 4", "Date x y z w", "late", "# c", None, "Value 1"]
    lines = spark.createDataFrame([(None if k else 1, i, 1, t) for k in (0, 1) for i, t in enumerate(texts)], "document_id long, place long, page int, text string")
    got = {(r.document_id, r.place): (r.name, r["values"], r.comments, r.problems) for r in machines.block_readings(lines, "^#", "^Results").collect()}
    one = {1: ("# a b", ["1", "2", "3", "4"], "late", []), 6: ("# c", None, None, ["values count", "no dates"])}
    assert got == {(d, p): v for d in (1, None) for p, v in one.items()}
    assert names == ["blocks"]
