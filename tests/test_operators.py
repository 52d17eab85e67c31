"""Operators on hand-made rows: nulls, ties, empty tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, temporal, text
from tallyforge.operators import aggregates, chunking, joins, reads, retrieval, store, windows
from tallyforge.operators.contracts import ColumnSpec, Contract
from tallyforge.sources import files


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


def test_text(spark):
    assert one(spark, text.collapse(F.lit("  a \n b "))) == "a b"
    assert one(spark, text.collapse(F.lit("   "))) is None
    assert one(spark, text.strip_html(F.lit("<p>a&amp;b<script>x<y</script><br>c"))) == "a&b c"
    assert one(spark, text.identifier(F.lit(" p 1"))) is None
    assert one(spark, text.decimal_text(F.lit(None).cast("decimal(9,2)"))) == "not stated"
    assert one(spark, text.search_tokens(F.lit("The a/b-1 of X.Y"))) == ["a/b-1", "b", "1", "x.y", "x", "y"]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) is None


def test_numbers_and_dates(spark):
    for raw, want in (("1,000", "1000.000000"), ("1.1234567", None), ("12,34", None), (" -5.5 ", "-5.500000"), (None, None)):
        assert one(spark, numbers.printed_number(F.lit(raw).cast("string")).cast("string")) == want
    assert one(spark, numbers.percentage(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.percentage(F.lit(1).cast("decimal(9,5)"), F.lit(8000).cast("decimal(9,5)")).cast("string")).startswith("0.01")
    assert one(spark, dates.day_or_month_end(F.lit("Feb/2024"))) == date(2024, 2, 29)
    assert one(spark, dates.first_date(F.lit("99/99/2020"), ("MM/dd/yyyy",))) is None


def test_windows(spark):
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, None), (1, 3, 2), (1, 4, 1), (2, 1, 5)], "k int, seq int, r int")
    runs = {tuple(r) for r in windows.runs_where(rows, ["k"], "seq", F.col("r") <= 3).collect()}
    assert runs == {(1, 1, 1, 1), (1, 3, 4, 2)}
    equal = {tuple(r) for r in windows.runs_of_equal(rows, ["k"], "seq", F.col("r")).collect()}
    assert equal == {(1, 2, 1, 1, 1), (1, None, 2, 2, 1), (1, 2, 3, 3, 1), (1, 1, 4, 4, 1), (2, 5, 1, 1, 1)}
    assert [(r["seq"], r["previous"]) for r in windows.changes(rows, ["k"], "seq", "r").collect()] == [(4, 2)]
    assert windows.runs_where(rows.limit(0), ["k"], "seq", F.col("r") <= 3).count() == 0


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", None, "x"), ("b", 2, "y"), ("b", 2, "z")], "k string, v int, w string")
    got = {r["k"]: (r["s"], r["w"]) for r in rows.groupBy("k").agg(aggregates.strict_sum(F.col("v")).alias("s"), aggregates.agreed(F.col("w")).alias("w")).collect()}
    assert got == {"a": (None, "x"), "b": (4, None)}
    assert {tuple(r) for r in aggregates.unique_max(rows.filter("k = 'b'"), ["k"], "v", "w").collect()} == {("b", None)}
    shuffled = rows.orderBy(F.col("w").desc())
    assert aggregates.fingerprint(rows, rows.columns).first() == aggregates.fingerprint(shuffled, rows.columns).first()


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, at int")
    right = spark.createDataFrame([(1, 5), (1, 7)], "k int, w int")
    found = {(r["k"], r["at"]): r["n"] for r in joins.next_match(left, right, ["k"], "at", "w", "n").collect()}
    assert found == {(1, 5): 5, (1, 9): None, (2, 1): None}
    points = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, 4), (4, 2, 9)], "id int, low int, high int")
    assert {r["id"] for r in joins.skyline(points, "id", ["low"], ["high"]).collect()} == {1, 2, 4}


def test_contract_and_merge(spark, tmp_path):
    c = Contract("t", ("id",), (ColumnSpec("id", "bigint", False, "KEY"), ColumnSpec("s", "string", vocabulary=("a", "b")), ColumnSpec("run", "string", role="OPERATIONAL")))
    first = c.finalize(spark.createDataFrame([(1, "a", "r1"), (2, "b", "r1")], "id long, s string, run string"), "s1")
    second = c.finalize(spark.createDataFrame([(1, "a", "r2"), (2, "z", "r2"), (3, None, "r2")], "id long, s string, run string"), "s2")
    assert {r["check"]: r["n"] for r in c.violations(second).collect()} == {"NULL_id": 0, "VOCABULARY_s": 1, "DUPLICATE_ID": 0, "HASH_DRIFT": 0}
    assert c.mismatch(first.drop("s")) == ["missing s"]
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    assert table.write_snapshot(first)["counts"]["INSERT"] == 2
    assert table.write_snapshot(second)["counts"] == {"INSERT": 1, "UPDATE": 1, "DELETE": 0, "KEEP": 1}
    assert table.write_snapshot(second)["version"] == 2  # nothing changed, nothing published
    assert {r["id"]: r["run"] for r in table.read().collect()} == {1: "r1", 2: "r2", 3: "r2"}
    assert table.read(1).count() == 2 and table.verify(table.read())


def test_reads(spark):
    rows = spark.createDataFrame([("P1", 1, None), ("P1", 2, 5), ("P2", 3, 6)], "p string, id int, v int")
    request = reads.ReadRequest("t", "P1", ("id",), (reads.Filter("v", "ge", 1),), ("-id",))
    assert [r["id"] for r in reads.collected(reads.read(request, {"t": (rows, "p")}))] == [2]
    for bad in (reads.ReadRequest("u", "P1", ("id",)), reads.ReadRequest("t", None, ("id",)), reads.ReadRequest("t", "P1", ("no",))):
        with pytest.raises(reads.ScopeError):
            reads.read(bad, {"t": (rows, "p")})
    with pytest.raises(Exception, match="row outside"):
        reads.guarded(rows, "p", "P1").collect()


def test_temporal():
    p = temporal.parse
    assert p("reports 2 to 4").sequences == (2, 3, 4)
    assert (p("in 2019").low, p("in 2019").high) == (date(2019, 1, 1), date(2019, 12, 31))
    assert p("after 2019").low == date(2020, 1, 1) and p("before 2019").high == date(2018, 12, 31)
    assert p("Q1 2024").high == date(2024, 3, 31) and p("february 2024").high == date(2024, 2, 29)
    assert p("the latest rating").kind == "LATEST" and p("why").kind == "ALL"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿banner,,\nProject ID , Amount,Extra\nid,amt,x\n p1 ,5,e\n,,\np2,n/a,\n", encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), {"id": ("project id", "id"), "amount": ("amt",)}, ("id",))
    assert {(r["id"], r["amount"], r["_extra_fields"].get("Extra")) for r in rows.collect()} == {(" p1 ", "5", "e"), ("p2", "n/a", None)}
    kept, counts = files.scoped(rows, "id", ["P1"])
    assert kept.count() == 1 and tuple(counts.first()) == (2, 0, 1)
    with pytest.raises(ValueError, match="money"):
        files.read_csv(spark, str(tmp_path / "a.csv"), {"money": ()}, ("money",))
    found = files.inventory(spark, str(tmp_path), {r"\.csv$": "TABLE"}).collect()
    assert [(r["kind"], r["size"] > 0) for r in found] == [("TABLE", True)]


def test_chunks_and_fusion(spark):
    body = " ".join(f"word{i}" for i in range(1000))
    cut = spark.createDataFrame([(1, body), (2, "x" * 3000), (3, ""), (4, None)], "i int, t string").orderBy("i").select(chunking.fixed(F.col("t")).alias("c")).collect()
    parts = cut[0]["c"]
    assert max(map(len, parts)) <= chunking.SIZE and set(" ".join(parts).split()) == set(body.split())
    assert all(len(set(a.split()) & set(b.split())) > 10 for a, b in zip(parts, parts[1:], strict=False))
    assert cut[1]["c"] == ["x" * 1200, "x" * 1200, "x" * 600] and cut[2]["c"] == cut[3]["c"] == []
    assert chunking.row_groups(["Name", "Value", "a 1", "b 2", "c 3", "d 4"], 22) == ["Name\nValue\na 1\nb 2\nc 3", "Name\nValue\nd 4"]
    assert chunking.row_groups(["Name", "Value", "a 1", "b 2", "c 3"], 20) == ["Name\nValue\na 1\nb 2", "c 3"] and chunking.row_groups(["Name"]) == ["Name"]
    docs = spark.createDataFrame([(1, body), (2, None), (3, "short")], "id int, t string")
    made = chunking.chunks(docs, "id", "t", structure=True)
    assert {r["id"] for r in made.collect()} == {1} and chunking.parents(made, "id").agg(F.max("parent_no")).first()[0] == 2
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "q string, d int, rank long")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "q string, d int, rank long")
    assert [r["d"] for r in retrieval.fused([a, b], "q", "d", 2).orderBy("rank").collect()] == [2, 1]


def test_stream(spark, tmp_path):
    from tallyforge.streaming import windows as w

    rows = spark.createDataFrame([("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:02:00", 2.0), ("2024-01-01 01:00:00", 3.0)], "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = w.tumbling(stream, "ts", [], "10 minutes", late="5 minutes").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]


def test_routing():
    from tallyforge.functions import routing as q

    names = {"river": "P1", "river basin": "P2", "P3": "P3"}
    assert [m.value for m in q.mentions("The River Basin and the river", names)] == ["P2", "P1"]
    assert q.resolved("river basin status", names, "P1", {"P2"}) == ("RESOLVED", "P2")
    assert q.resolved("status", names, None, {"P2"}) == ("MISSING", None) and q.resolved("P3", names, None, {"P2"})[0] == "FORBIDDEN"
    rules = {"rating": r"rating", "history": r"rating history", "money": r"disburse\w*"}
    assert q.intents("rating history and disbursement", rules) == ["history", "money"]
    assert q.decision("RESOLVED", ["history"], {"history"}) == ("DIRECT", "PLAIN") and q.decision("FORBIDDEN", [], set())[0] == "REFUSE"
    with pytest.raises(q.QuestionError):
        q.validated(" \n ")


def test_extraction(spark):
    from tallyforge.operators import extraction as x

    row = spark.range(1).select(x.labelled(F.lit("a\nRating: High\n"), "rating", r"\w+").alias("a"), x.in_vocabulary(F.lit(" high "), {"high": "High"}).alias("b"), x.one_reading(F.lit(1), F.lit(2)).alias("c"), x.exact_tokens(F.lit("1 2 3"), "[0-9]", 2).alias("d"), x.cited_dates(F.lit("2020-01-02, 2020-13-01, 2020-01-02")).alias("e")).first()
    assert (row["a"], tuple(row["b"]), tuple(row["c"]), row["d"], row["e"]) == ("High", ("High", "NORMALIZED"), (None, "CONFLICT"), None, [date(2020, 1, 2)])
    rows = spark.createDataFrame([(1, 1, "h"), (1, 2, None), (1, 3, "g"), (2, 1, None)], "k int, o int, v string")
    assert [r["c"] for r in x.carried(rows, ["k"], "o", F.col("v"), "c").orderBy("k", "o").collect()] == ["h", "h", "g", None]


def test_fixed_chunks_against_brute_force(spark):
    """Whatever the text, chunks are its own pieces in order, none too long; nothing but white space is between them; a piece
    ends at the last white space of its second half, if there is one."""
    import random

    rng = random.Random(11)
    for size, overlap in ((20, 0), (47, 8), (90, 3), (64, 20)):
        bodies = []
        for _ in range(80):
            body = ""
            for i in range(rng.randrange(400)):  # no character stands twice, and no two white spaces stand together
                body += rng.choice(" \n") if body and not body[-1].isspace() and rng.random() < rng.choice([0.02, 0.3]) else chr(0x4E00 + i)
            bodies.append(body)
        found = spark.createDataFrame([(b,) for b in bodies], "t string").select("t", chunking.fixed(F.col("t"), size, overlap).alias("c")).collect()
        for body, pieces in found:
            at = covered = 0
            for piece in pieces:
                start = body.find(piece, at)
                assert 0 < len(piece) <= size and start >= 0
                assert start <= covered or not body[covered:start].strip()
                end = start + len(piece)
                assert end >= len(body.rstrip()) or body[end].isspace() or not any(c.isspace() for c in body[start + size // 2 + 1 : start + size])
                at, covered = start, max(covered, end)
            assert not body[covered:].strip()


def test_parents_against_a_loop(spark):
    import random

    rng = random.Random(7)
    rows = [(i, no, "x" * rng.randrange(1, 120)) for i in range(20) for no in range(rng.randrange(1, 12))]
    want = {}
    for i in range(20):
        used, parent = 0, -1
        for _, no, t in [r for r in rows if r[0] == i]:
            if parent < 0 or used + len(t) > 200:
                used, parent = 0, parent + 1
            used += len(t)
            want[i, no] = parent
    found = chunking.parents(spark.createDataFrame(rows, "id long, no long, chunk_text string"), "id", 200)
    assert {(r["id"], r["no"]): r["parent_no"] for r in found.collect()} == want
