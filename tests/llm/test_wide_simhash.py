"""The covering by thirds against all pairs, and its part in the pipeline's near-dedup stage."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import resemblance, simhash
from tallyforge.llm.components import components


@pytest.mark.parametrize("block", [8, 4096])
def test_five_bits_by_brute_force(spark, block):
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(4):
            for at in rng.sample(range(64), rng.randint(1, 7)):
                f ^= 1 << at
            prints.add(f)
    prints = np.array(sorted(prints), dtype=np.uint64)
    pairs = [(i, j) for i, a in enumerate(prints) for j in range(i) if int(a ^ prints[j]).bit_count() <= 5]
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)
    signed = prints.view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(frame, block, simhash.THIRDS)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all((signed[i] in got) == any(i in p for p in pairs) for i in range(len(signed)))
    groups = lambda of: {frozenset(i for i in range(len(signed)) if of(i) == t) for t in {of(i) for i in range(len(signed))}}
    assert groups(top) == groups(lambda i: got.get(signed[i], signed[i]))


def test_stage_takes_pairs_of_the_covering(spark):
    """Without a band in common, near copies within five bits are linked all the same, unlike sets are not."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(900)]
    near, unlike = [*words[:400], "x", *words[401:]], [f"v{i}" for i in range(900)]
    found = [resemblance.shingles(" ".join(w)) for w in (words, near)]
    assert 0 < (simhash.majority(found[0]) ^ simhash.majority(found[1])).bit_count() <= 5
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, unlike))], "doc_id long, text string")
    rows = resemblance._sketches(docs).withColumnRenamed("doc_id", "first_id")
    apart = rows.withColumn("bands", F.array(F.col("first_id")))
    edges = [{*e} for e in resemblance.links(apart, docs).collect()]
    keys = {r["first_id"]: r["key"] for r in rows.collect()}
    assert edges == [{keys[0], keys[1]}]
