"""Facts read out of texts and markup, and the policies of reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import extraction, policies
from tallyforge.plans.retrieval import _BM25, _FUSED, _fused, _lexical

LICENSES = {"mit": "MIT", "apache": "APACHE", "gnu": "GPL", "cc": "CC"}


@query("labelled_values", r"SELECT doc_id, nullif(regexp_extract(text, '(?im)\btoken\s*[:=]\s*[" + "\"''" + r"]?([0-9a-f]{8,})', 1), '') AS token FROM documents WHERE contains(text, 'token')")
def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.contains("text", F.lit("token")))
    return docs.select("doc_id", extraction.labelled(F.col("text"), "token", "[0-9a-f]{8,}").alias("token"))


@query(
    "vocabulary_status",
    r"WITH r AS (SELECT doc_id, regexp_extract(text, '(?i)(?:under|the) (?:the )?(MIT|Apache|GNU|CC|BSD)\b', 1) AS raw FROM documents), v AS (SELECT doc_id, raw, CASE lower(raw) WHEN 'mit' THEN 'MIT' WHEN 'apache' THEN 'APACHE' WHEN 'gnu' THEN 'GPL' WHEN 'cc' THEN 'CC' END AS value FROM r) SELECT doc_id, value, CASE WHEN raw = '' THEN 'MISSING' WHEN value IS NULL THEN 'AMBIGUOUS' WHEN value = raw THEN 'EXACT' ELSE 'NORMALIZED' END AS status FROM v",
)
def vocabulary_status(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract("text", r"(?i)(?:under|the) (?:the )?(MIT|Apache|GNU|CC|BSD)\b", 1)
    return table(spark, d, "documents").select("doc_id", extraction.in_vocabulary(raw, LICENSES).alias("x")).select("doc_id", "x.value", "x.status")


@query(
    "agreed_readings",
    r"WITH r AS (SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS a, nullif(regexp_extract(html, '<h1>([^<]*)', 1), '') AS b FROM pages) SELECT page_id, CASE WHEN a IS NULL OR b IS NULL OR a = b THEN coalesce(a, b) END AS value, CASE WHEN a IS NULL AND b IS NULL THEN 'MISSING' WHEN a <> b THEN 'CONFLICT' ELSE 'EXACT' END AS status FROM r",
)
def agreed_readings(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda tag: F.nullif(F.regexp_extract("html", f"<{tag}>([^<]*)", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", extraction.one_reading(cell("title"), cell("h1")).alias("x")).select("page_id", "x.value", "x.status")


@query("exact_cells", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b'), ',') AS cells FROM documents WHERE len(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b')) = 1")
def exact_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", extraction.exact_tokens(F.col("text"), r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", 1).alias("cells"))
    return rows.filter("cells is not null").select("doc_id", F.array_join("cells", ",").alias("cells"))


@query(
    "line_blocks",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), b AS (SELECT doc_id, length(line) AS n, sum(CASE WHEN starts_with(line, 'The ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l) SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS lines, CAST(sum(n) AS BIGINT) AS chars FROM b GROUP BY ALL",
)
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = extraction.blocks(extraction.lines(table(spark, d, "documents"), "doc_id", "text"), ["doc_id"], "no", F.col("line").startswith("The "))
    return rows.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(
    "conversation_furniture",
    "WITH l AS (SELECT conv_id, turn, lower(regexp_replace(split_part(text, ' ', 1), '[0-9]+', '#', 'g')) AS signature FROM conversations), p AS (SELECT conv_id, count(DISTINCT turn) AS n FROM l GROUP BY 1) SELECT l.conv_id, signature FROM l JOIN p USING (conv_id) GROUP BY l.conv_id, signature, n HAVING count(DISTINCT turn) >= 2 AND count(DISTINCT turn) >= 0.3 * n",
)
def conversation_furniture(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split_part("text", F.lit(" "), F.lit(1)).alias("line"))
    return extraction.furniture(rows, ["conv_id"], "turn", "line", least=2, share=0.3)


@query(
    "rerank_triggers",
    f"""WITH {_BM25}, {_FUSED}, a AS (SELECT item_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS next FROM lex GROUP BY 1),
o AS (SELECT lex.item_id, count(fused.doc_id) AS common FROM lex LEFT JOIN fused ON fused.item_id = lex.item_id AND fused.doc_id = lex.doc_id AND fused.rank <= 5 WHERE lex.rank <= 5 GROUP BY 1),
feats AS (SELECT item_id, round((top - coalesce(next, 0)) / top, 4) AS margin, round(common / 5, 6) AS overlap FROM a JOIN o USING (item_id)) SELECT item_id, margin, overlap, margin < 0.1 OR overlap <= 0.4 AS rerank FROM feats""",
)
def rerank_triggers(spark: SparkSession, d: str) -> DataFrame:
    lex = _lexical(spark, d).withColumn("score", F.round("score", 6))
    rows = policies.features(lex, _fused(spark, d), "item_id", "doc_id").withColumn("margin", F.round("margin", 4))
    return rows.select("item_id", "margin", "overlap", policies.triggered("either").alias("rerank"))
