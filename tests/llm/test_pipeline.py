"""The pipeline's stages on the smallest tables, and the queries' SQL."""

from __future__ import annotations

import corpus_pipeline
from tallyforge.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "personal_data", "mixture", "tokens"]
    assert sizes[1] <= sizes[0] and sizes[1] >= 0.95 * sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] == sizes[5]
    ran = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "n_tokens", "ids_sha256"]
    assert sorted(map(tuple, ran.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_every_operator_has_its_query():
    assert {q.split("_")[0] for q in queries.queries()} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_on_edge_tables(spark):
    """Each stage by itself: no rows, nulls everywhere, repeats, and columns whose names operators might use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, Nth long, taken string, Size int"
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "a", 9, 1, "t", 1), (1, words, "en", "a", 9, 1, "t", 1), (2, None, None, None, None, None, None, None), (None, "", "en", "b", 0, 1, "t", 1), (3, "mail jo@x.example.com " * 2000, "en", None, 1, 1, "t", 1)]
    for name, function in corpus_pipeline.STAGES:
        for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
            out = function(spark, table, DATA)
            found = out.collect()
            if name != "tokens":
                assert out.columns == table.columns, name
            if table.isEmpty():
                assert not found, name
            elif name == "tokens":
                assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "2", "3", "None"] and all(len(r["ids"]) == r["n_tokens"] for r in found)
            elif name == "near_dedup":
                assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3"]
            elif name == "personal_data":
                assert len(found) == 5 and not any("jo@x" in (r["text"] or "") for r in found)
