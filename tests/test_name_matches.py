"""Names that may be one: all pairs by brute force with small slices, and as many tasks as the pairs need."""

from __future__ import annotations

import random

from tallyforge.operators import similarity


def test_pairs_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 3)
    monkeypatch.setattr(similarity, "PAIRS", 50)
    rng = random.Random(5)
    words = ["road", "roads", "water", "of", "the north"]
    rows = [(rng.choice(["x", "y", None]), rng.randrange(80) if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", " (km)", " - "])) for i in range(120)]
    base = lambda t: " ".join(t.removesuffix(" (km)").replace("-", " ").split())
    want = []
    for b, k, t in rows:
        for c, m, u in rows:
            p, q = base(t), base(u)
            if b is None or b != c or k is None or m is None or not k < m:
                continue
            if p == q:
                want.append((b, k, m, "SAME_BASE"))
            elif min(len(p), len(q)) >= 5 and (p.startswith(q) or q.startswith(p)):
                want.append((b, k, m, "PREFIX"))
    found = similarity.possible_matches(spark.createDataFrame(rows, "b string, k long, t string"), ["b"], "k", "t", 5)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert {r[3] for r in want} == {"SAME_BASE", "PREFIX"}
    assert found.rdd.getNumPartitions() >= len(want) // 50
