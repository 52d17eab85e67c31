"""Chunks, BM25, exact nearest vectors, fusion, votes and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.functions.text import EMBEDDING_STOPWORDS
from tallyforge.operators import changes, chunking, lexical, vectors
from tallyforge.operators import retrieval as r
from tallyforge.plans.scalars import TOKENS
from tallyforge.staging import shared_folder, staged

_TOK = TOKENS.replace("lower(text)", "lower(body)")
_BM25 = f"""docs AS (SELECT doc_id, text AS body FROM documents), t AS (SELECT doc_id, {_TOK} AS w FROM docs), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT doc_id, term, len_, count(*) AS tf FROM (SELECT doc_id, len(w) AS len_, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, unnest(list_distinct({_TOK})) AS term FROM (SELECT item_id, text AS body FROM benchmark)),
bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_ / avgdl))), 9) AS score FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id),
lex AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10)"""


def _lexical(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    index = lexical.kept(table(spark, d, "documents"), "doc_id", "text")
    return lexical.search(spark, index, table(spark, d, "benchmark"), "item_id", "text", k).withColumnRenamed("doc", "doc_id")


@query("bm25_top_k", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM lex")
def bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item's best documents, from an index that is kept."""
    return _lexical(spark, d).withColumn("score", F.round("score", 6))


@query("bm25_scanned", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM lex")
def bm25_scanned(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: one pass over the texts for all questions."""
    found = r.bm25(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", 10)
    return found.withColumn("score", F.round("score", 6))


_NEAR = "near AS (SELECT q.vec_id AS query_id, v.vec_id, v.label AS vlabel, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near QUALIFY rank <= 10)"


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every 20th vector against all vectors."""
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return r.nearest(v.select("vec_id", "embedding", F.col("label").alias("vlabel")), "vec_id", "embedding", q, "query_id", "query_vector", 10, 6)


@query("dense_top_k", f"WITH {_NEAR} SELECT query_id, vec_id, score, rank FROM top")
def dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("query_id", "vec_id", "score", "rank")


@query("vector_index_top_k", f"WITH {_NEAR} SELECT query_id, vec_id, score, rank FROM top")
def vector_index_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The same from a kept index of an older state, in which some vectors were missing, reversed or not yet gone, after it
    followed the change feed to the table's state."""
    now = table(spark, d, "embeddings").select("vec_id", "embedding")
    k = F.col("vec_id")
    reversed_ = F.when(k % 11 == 5, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")).alias("embedding")
    old = now.filter(k % 7 != 3).select("vec_id", reversed_).unionByName(now.filter(k % 13 == 0).select((-1 - k).alias("vec_id"), "embedding"))
    folder = shared_folder(spark)
    index = vectors.built(old, "vec_id", "embedding", f"{folder}/index")
    changes.record(changes.changes(old, now, ["vec_id"]), f"{folder}/feed", 1)
    vectors.sync(spark, index, spark.read.parquet(f"{folder}/feed"))
    asked = now.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.search(spark, index, asked, "query_id", "embedding", 10, itself=False, places=6)


@query(
    "knn_vote",
    f"WITH {_NEAR}, w AS (SELECT query_id, vlabel, sum(CAST(score AS DECIMAL(18,9))) AS weight FROM top WHERE score >= 0.05 GROUP BY ALL), s AS (SELECT *, sum(weight) OVER (PARTITION BY query_id) AS whole, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, vlabel) AS k FROM w) SELECT query_id, CASE WHEN round(weight::DOUBLE / whole::DOUBLE, 6) >= 0.3 THEN vlabel END AS vlabel, round(weight::DOUBLE / whole::DOUBLE, 6) AS share FROM s WHERE k = 1",
)
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    return r.vote(_nearest(spark, d), "query_id", "vlabel", 0.05, 0.3)


_FUSED = "u AS (SELECT item_id, doc_id, rank FROM lex UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS rank FROM lex JOIN documents USING (doc_id)), f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL), fused AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5)"


def _fused(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    lex = _lexical(spark, d)
    sizes = table(spark, d, "documents").select("doc_id", "n_chars")
    other = lex.select("item_id", "doc_id").join(sizes, "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")))
    return r.fused([lex, other], "item_id", "doc_id", 5)


@query("rank_fusion", f"WITH {_BM25}, {_FUSED} SELECT item_id, doc_id, score, rank FROM fused")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("item_id", "doc_id", "score", "rank")


_HASHED = """hw AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
hc AS (SELECT side, id, w, count(*) AS c FROM (SELECT side, id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({}))) AS w FROM hw) GROUP BY ALL),
hg AS (SELECT side, id, c, '#' || w || '#' AS w, n, unnest(range(1, len(w) + 4 - n)) AS i FROM hc, (VALUES (3), (4)) v(n)),
hf AS (SELECT side, id, 'w:' || w AS t, 1.0::DOUBLE * c AS x FROM hc UNION ALL SELECT side, id, 'c' || n || ':' || substr(w, i, n), 0.5::DOUBLE * c FROM hg),
he AS (SELECT side, id, CAST('0x' || substr(sha1(t), 1, 8) AS BIGINT) % 256 AS dim, sum(x) AS x FROM hf GROUP BY ALL), hn AS (SELECT side, id, sqrt(sum(x * x)) AS norm FROM he GROUP BY ALL),
dense AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid AS item_id, did AS doc_id, round(dot / (qn.norm * dn.norm), 9) AS score FROM (SELECT q.id AS qid, d.id AS did, sum(q.x * d.x) AS dot FROM he q JOIN he d ON q.dim = d.dim WHERE q.side = 'q' AND d.side = 'd' GROUP BY ALL) p
  JOIN hn qn ON qn.side = 'q' AND qn.id = qid JOIN hn dn ON dn.side = 'd' AND dn.id = did) QUALIFY rank <= 10)""".format(", ".join(f"'{w}'" for w in EMBEDDING_STOPWORDS))


def _dense(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Every benchmark item's nearest documents by hashed embeddings of 256 dimensions, from a kept vector index."""
    folder = shared_folder(spark)
    hashed = lambda name, key: staged(r.hashed_vectors(table(spark, d, name), key, "text"), folder, name)
    index = vectors.built(hashed("documents", "doc_id"), "doc_id", "vector", f"{folder}/index")
    return vectors.search(spark, index, hashed("benchmark", "item_id"), "item_id", "vector", k)


@query(
    "hybrid_top_k",
    f"WITH {_BM25}, {_HASHED}, f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(CASE WHEN list = 'l' THEN rank END) AS lexical_rank, min(CASE WHEN list = 'd' THEN rank END) AS dense_rank FROM (SELECT 'l' AS list, item_id, doc_id, rank FROM lex UNION ALL SELECT 'd', item_id, doc_id, rank FROM dense) GROUP BY item_id, doc_id) SELECT item_id, doc_id, score, lexical_rank, dense_rank, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10",
)
def hybrid_top_k(spark: SparkSession, d: str) -> DataFrame:
    """A lexical and a dense list of each item fused, with the ranks that a document has in either."""
    lists = {name: staged(df.select("item_id", "doc_id", "rank"), shared_folder(spark), name) for name, df in (("lexical", _lexical(spark, d)), ("dense", _dense(spark, d)))}
    out = r.fused(list(lists.values()), "item_id", "doc_id", 10)
    for name, df in lists.items():
        out = out.join(df.withColumnRenamed("rank", f"{name}_rank"), ["item_id", "doc_id"], "left")
    return out.select("item_id", "doc_id", "score", "lexical_rank", "dense_rank", "rank")


@query(
    "ranking_metrics",
    f"""WITH {_BM25}, rel AS (SELECT item_id, doc_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)),
j AS (SELECT rel.item_id, rank FROM rel LEFT JOIN lex ON lex.item_id = rel.item_id AND lex.doc_id = rel.doc_id), a AS (SELECT item_id, count(*) AS n, count(rank) AS hit, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM j GROUP BY 1)
SELECT item_id, round(hit / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(hit / 10, 6) AS precision FROM a""",
)
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    relevant = r.quoting(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")
    return r.ranking_metrics(_lexical(spark, d), relevant, "item_id", "doc_id", 10)


@query("best_candidates", "SELECT source, sha256(lower(text)) AS h, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(lower(text)) ORDER BY doc_id) = 1")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.sha2(F.lower("text"), 256).alias("h"), "doc_id", "n_chars")
    return r.best_candidate(rows, [F.col("source"), F.col("h")], "doc_id")


@query("fixed_chunks")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text")


@query("structured_chunks")
def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text", structure=True)


@query("parent_chunks")
def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.parents(chunking.chunks(table(spark, d, "documents"), "doc_id", "text", structure=True), "doc_id")


_PLAIN = ", ".join(f"'{w}'" for w in EMBEDDING_STOPWORDS)


@query(
    "hashed_embeddings",
    f"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({_PLAIN}))) AS w FROM benchmark),
g AS (SELECT item_id, '#' || w || '#' AS w, n, unnest(range(1, len(w) + 4 - n)) AS i FROM w, (VALUES (3), (4)) v(n)),
f AS (SELECT item_id, 'w:' || w AS t, 1.0::DOUBLE AS x FROM w UNION ALL SELECT item_id, 'c' || n || ':' || substr(w, i, n), 0.5 FROM g),
s AS (SELECT item_id, CAST('0x' || substr(sha1(t), 1, 8) AS BIGINT) % 262144 AS dim, sum(x) AS x FROM f GROUP BY ALL) SELECT item_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS weight FROM s""",
)
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return r.hashed_embedding(table(spark, d, "benchmark"), "item_id", "text")


@query(
    "counterfactual_classes",
    f"""WITH {_BM25}, {_FUSED}, rel AS (SELECT item_id, doc_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)),
a AS (SELECT rel.item_id, min(lex.rank) AS before, min(fused.rank) AS after FROM rel LEFT JOIN lex USING (item_id, doc_id) LEFT JOIN fused USING (item_id, doc_id) GROUP BY 1)
SELECT item_id, before, after, CASE WHEN before IS NULL AND after IS NULL THEN 'MISS' WHEN before IS NULL OR after < before THEN 'HELPED' WHEN after IS NULL OR after > before THEN 'HURT' ELSE 'NEUTRAL' END AS class FROM a""",
)
def counterfactual_classes(spark: SparkSession, d: str) -> DataFrame:
    relevant = r.quoting(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")
    lex, fused = _lexical(spark, d).select("item_id", "doc_id", F.col("rank").alias("b")), _fused(spark, d).select("item_id", "doc_id", F.col("rank").alias("a"))
    rows = relevant.join(lex, ["item_id", "doc_id"], "left").join(fused, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("b").alias("before"), F.min("a").alias("after"))
    b, a = F.col("before"), F.col("after")
    return rows.withColumn("class", F.when(b.isNull() & a.isNull(), "MISS").when(b.isNull() | (a < b), "HELPED").when(a.isNull() | (a > b), "HURT").otherwise("NEUTRAL"))


@query(
    "threshold_calibration",
    f"""WITH {_BM25}, rel AS (SELECT DISTINCT item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)), tops AS (SELECT item_id, max(score) AS score FROM lex GROUP BY 1)
SELECT tops.item_id, score, rel.item_id IS NOT NULL AS answerable, count(*) OVER w AS kept, count(rel.item_id) OVER w AS right_ FROM tops LEFT JOIN rel ON rel.item_id = tops.item_id WINDOW w AS (ORDER BY score DESC, tops.item_id ROWS UNBOUNDED PRECEDING)""",
)
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    """For each possible threshold how many questions would be answered and how many of them rightly."""
    from pyspark.sql import Window

    relevant = r.quoting(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id").select(F.col("item_id").alias("k")).distinct()
    s = _lexical(spark, d).groupBy("item_id").agg(F.round(F.max("score"), 6).alias("score")).join(relevant, F.col("item_id") == F.col("k"), "left")
    w = Window.orderBy(F.col("score").desc(), "item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.select("item_id", "score", F.col("k").isNotNull().alias("answerable"), F.count(F.lit(1)).over(w).alias("kept"), F.count("k").over(w).alias("right_"))
