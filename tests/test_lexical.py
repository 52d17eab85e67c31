"""The kept index finds what a scan of all texts finds."""

from __future__ import annotations

import random

from tallyforge.operators import lexical, retrieval


def test_index_is_the_scan(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # a few words are everywhere
    texts = [" ".join(r.choices(words, weights, k=r.randint(0, 60))) for _ in range(150)] + [None, "", "w59 w59 w58"]
    asked = [" ".join(r.choices(words, weights, k=n)) for n in (1, 2, 3, 5, 8, 13, 30)] + ["w59 w58 w0 w1", "nothing here", None, ""]
    docs, queries = spark.createDataFrame([*enumerate(texts)], "d long, t string"), spark.createDataFrame([*enumerate(asked)], "q long, x string")
    index = lexical.build(docs, "d", "t", f"file://{tmp_path}")
    assert index.documents == len(texts)
    for k in (1, 5, 1000):
        got = lexical.search(spark, index, queries, "q", "x", k).select("q", "doc", "rank", "score").collect()
        want = retrieval.bm25(docs, "d", "t", queries, "q", "x", k).select("q", "d", "rank", "score").collect()
        assert sorted((a, b, c, round(s, 8)) for a, b, c, s in got) == sorted((a, b, c, round(s, 8)) for a, b, c, s in want)


def shuffled_rows(spark, job):
    """How many rows the stages of ``job`` wrote for shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    job()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = stages()
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()) if found.apply(i).stageId() not in before)


def test_questions_with_frequent_words_pair_with_no_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"red green blue x{i}") for i in range(400)], "d long, t string")
    queries = spark.createDataFrame([(i, f"red green blue x{i}") for i in range(60)], "q long, x string")
    index = lexical.build(docs, "d", "t", f"file://{tmp_path}")
    # 1,260 postings are asked; 60 questions meet 400 documents each
    assert shuffled_rows(spark, lambda: lexical.search(spark, index, queries, "q", "x", 5).collect()) < 12_000


def test_sums_in_small_steps(spark, monkeypatch):
    """Documents over many parts and steps, ties by document, keys and queries that are strings or null."""
    monkeypatch.setattr(retrieval, "AT_ONCE", 7)
    monkeypatch.setattr(retrieval, "PART", 10)
    r = random.Random(3)
    parts = [(f"d{i:03}", t, float(r.randint(1, 3))) for i in range(90) for t in r.sample(range(9), r.randint(1, 9))]
    asked = [(f"q{i}", t, float(r.randint(1, 2))) for i in range(6) for t in r.sample(range(12), 4)]
    sums = {}
    for d, t, part in parts:
        for q, t2, idf in asked:
            if t == t2:
                sums[q, d] = sums.get((q, d), 0) + part * idf
    want = [(q, d, float(s), n + 1) for q in {q for q, _ in sums} for n, (s, d) in enumerate(sorted(((s, d) for (p, d), s in sums.items() if p == q), key=lambda x: (-x[0], x[1]))[:8])]
    got = retrieval.best_sums(spark.createDataFrame([*parts, (None, 1, 1.0)], "d string, number long, part double"), "d", spark.createDataFrame([*asked, (None, 1, 1.0)], "q string, number long, idf double"), "q", 8, 90)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert retrieval.best_sums(spark.createDataFrame([], "d string, number long, part double"), "d", spark.createDataFrame(asked, "q string, number long, idf double"), "q", 8, 0).count() == 0


def test_scan_pairs_no_question_with_a_document(spark):
    docs = spark.createDataFrame([(i, f"red green blue x{i}") for i in range(400)], "d long, t string")
    queries = spark.createDataFrame([(i, f"red green blue x{i}") for i in range(60)], "q long, x string")
    assert shuffled_rows(spark, lambda: retrieval.bm25(docs, "d", "t", queries, "q", "x", 5).collect()) < 12_000
