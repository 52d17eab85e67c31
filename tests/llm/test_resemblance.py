"""The pipeline's near-dedup stage against all pairs of 5-word sets."""

from __future__ import annotations

import random

import corpus_pipeline
from tallyforge.llm import simhash

DATA = "/root/testdata/sf0.001"


def runs(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) <= 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stage_by_brute_force(spark):
    rng = random.Random(7)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for base in [t for t in texts if t and len(t.split()) > 60][:25]:
        for _ in range(4):
            w = base.split()
            for at in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 40))):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "One  two", "a b c d e f", "a b c d e g"]
    sets = [runs(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    prints = [simhash.fingerprint(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if a == b or (n and 5 * n >= 4 * (len(a) + len(b) - n)):
                far += (prints[i] ^ prints[j]).bit_count() > simhash.THRESHOLD
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    assert far > 10  # pairs that the SimHash of op3 does not link
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if top(i) == i]
    assert kept.columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), DATA).count() == 0
