"""The kept vector index against brute force: exact search, ties, extreme vectors, hot lists, sync from a feed, recall."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import changes, vectors
from tallyforge.staging import shared_folder


def brute(rows, asked, k, itself, places=9):
    """(query, key, score, rank) over all pairs."""
    good = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    known = [(i, np.array(v) / max(abs(np.array(v)))) for i, v in rows if good(v)]
    out = set()
    for q, v in asked:
        if not good(v):
            continue
        w = np.array(v) / max(abs(np.array(v)))
        s = sorted((-round(float(w @ x / np.sqrt((w @ w) * (x @ x))), places), i) for i, x in known if itself or i != q)
        out |= {(q, i, -c, n) for n, (c, i) in enumerate(s[:k], 1)}
    return out


def got(df):
    return {tuple(r) for r in df.collect()}


def near(a, b):
    """Equal but for the last places of scores."""
    flat = lambda s: sorted((q, n, i, round(c, 6)) for q, i, c, n in s)
    return flat(a) == flat(b)


@pytest.fixture(scope="module")
def crowd():
    """400 vectors: half of them around one direction, copies that tie, and some without a direction."""
    r = np.random.default_rng(5)
    middle = r.normal(size=12)
    rows = [(i, (middle + r.normal(size=12) * 0.1 if i % 2 else r.normal(size=12)).round(4).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(0, 60, 3)]
    odd = [[0.0] * 12, None, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [None] + [1.0] * 11]
    return rows + [(900 + i, v) for i, v in enumerate(odd)]


def test_exact_and_approximate(spark, crowd, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # many blocks of the hot list
    monkeypatch.setattr(vectors, "TOGETHER", 5)
    df = spark.createDataFrame(crowd, "id long, v array<double>")
    index = vectors.built(df, "id", "v", f"{shared_folder(spark)}/i", lists=12)
    asked = [(i, v) for i, v in crowd if i % 7 == 0 or i >= 900]
    q = spark.createDataFrame(asked, "q long, v array<double>")
    for itself in (True, False):
        found = got(vectors.search(spark, index, q, "q", "v", 6, probes=2, itself=itself))
        assert near(found, brute(crowd, asked, 6, itself))
    want = {(a, b) for a, b, _, _ in brute(crowd, asked, 6, True)}
    about = {(a, b) for a, b, _, _ in got(vectors.search(spark, index, q, "q", "v", 6, probes=6, exact=False))}
    assert len(about & want) / len(want) >= 0.9


def test_extreme_sizes(spark):
    rows = [("tiny", [1e-200, 2e-200]), ("huge", [1e200, 2e200]), ("mixed", [1e-300, 1e200]), ("other", [1.0, -1.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    index = vectors.built(df, "id", "v", f"{shared_folder(spark)}/i", lists=2)
    found = got(vectors.search(spark, index, df.withColumnRenamed("id", "q"), "q", "v", 4, probes=1))
    assert near(found, brute(rows, rows, 4, True))


def test_sync(spark, crowd, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    folder = shared_folder(spark)
    states = [
        [r for r in crowd if r[0] % 5],
        [(i, [-x for x in v] if v and i < 40 else v) for i, v in crowd if i % 4],
        [(i, v) for i, v in crowd if i % 4 != 1 and i < 900],
    ]
    frames = [spark.createDataFrame(s, "id long, v array<double>") for s in states]
    index = vectors.built(frames[0], "id", "v", f"{folder}/i", lists=8)
    asked = [(i, v) for i, v in crowd if i % 11 == 0]
    q = spark.createDataFrame(asked, "q long, v array<double>")
    with pytest.raises(TimeoutError):
        vectors.wait(spark, index, 1, 0.0)
    for n in (1, 2):
        changes.record(changes.changes(frames[n - 1], frames[n], ["id"]), f"{folder}/feed", n)
        feed = spark.read.parquet(f"{folder}/feed")
        assert vectors.sync(spark, index, feed) == n == vectors.wait(spark, index, n, 0.0)
        assert vectors.sync(spark, index, feed) == n  # nothing is left to do
        assert near(got(vectors.search(spark, index, q, "q", "v", 5, probes=2)), brute(states[n], asked, 5, True))
    # a reader who comes late takes both versions at once
    late = vectors.built(frames[0], "id", "v", f"{folder}/late", lists=8)
    assert vectors.sync(spark, late, spark.read.parquet(f"{folder}/feed")) == 2
    assert near(got(vectors.search(spark, late, q, "q", "v", 5, probes=2)), brute(states[2], asked, 5, True))


def test_empty(spark):
    folder = shared_folder(spark)
    none = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    index = vectors.built(none, "id", "v", f"{folder}/i")
    q = some.withColumnRenamed("id", "q")
    assert not got(vectors.search(spark, index, q, "q", "v", 3))
    changes.record(changes.changes(none, some, ["id"]), f"{folder}/feed", 1)
    vectors.sync(spark, index, spark.read.parquet(f"{folder}/feed"))
    assert near(got(vectors.search(spark, index, q, "q", "v", 3)), {(1, 1, 1.0, 1), (1, 2, 0.0, 2), (2, 2, 1.0, 1), (2, 1, 0.0, 2)})
    assert not got(vectors.search(spark, index, q.filter(F.lit(False)), "q", "v", 3))


def test_cells_pass_on_few_rows(spark, tmp_path, monkeypatch):
    """However many blocks a list has, a cell passes on k rows of each query; cut into cells the answer stays the same."""
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vectors.built(df, "id", "v", f"file://{tmp_path}/cells", lists=3)
    q = df.filter("id % 20 = 0").withColumnRenamed("id", "q")
    wide = got(vectors.search(spark, index, q, "q", "v", 5, probes=1))
    monkeypatch.setattr(vectors, "CELL", 2)
    assert wide == got(vectors.search(spark, index, q, "q", "v", 5, probes=1)) and len(wide) == 150
    made = "list int, key long, vector array<double>, near double"
    packs = vectors._packed(spark.createDataFrame([(0, r[0], r[1], 1.0) for r in rows[:10]], made), "long", 256, "q")
    blocks = vectors._blocks(spark, index, 0).withColumn("list", F.lit(0))
    assert blocks.count() > 60
    hits = vectors._scored(blocks, packs, index, "q", "long", 5, 9, (1, 1))
    assert hits.count() == 50
