"""The queries opN_<name> of this subpackage and their SQL: thin applications of the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, embed_dedup, langid, licenses, mixing, omh, pii, simhash, tokencounts, urlfilter, validtime

#: For the given invented tables only; set ``KEY_SETTING`` in the session to a key of your own for any others.
TABLES_KEY, KEY_SETTING = "tallyforge-invented-tables", "spark.tallyforge.pii.key"

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TABLES_KEY)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprinted(_read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"), pii_key(spark))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_read(spark, sf_dir, "documents")).drop("detections")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_read(spark, sf_dir, "conversations"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_read(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_read(spark, sf_dir, "pages"))


def op11_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validtime.enriched(_read(spark, sf_dir, "sales"), _read(spark, sf_dir, "client_changes"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_read(spark, sf_dir, "documents"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counted(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_embeddings": op2_embeddings,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_fingerprints": op5_fingerprints,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_chat": op8_chat,
    "op9_languages": op9_languages,
    "op10_urls": op10_urls,
    "op11_sales": op11_sales,
    "op12_alignment": op12_alignment,
    "op13_tokens": op13_tokens,
    "pipeline": pipeline,
}


def _like(globs: tuple[str, ...], column: str) -> str:
    return " OR ".join(f"{column} LIKE '{g.replace('*', '%')}'" for g in globs)


def _first_like(globs: tuple[str, ...], column: str) -> str:
    return " ".join(f"WHEN {column} LIKE '{g.replace('*', '%')}' THEN '{g}'" for g in globs)


def _urls_sql() -> str:
    fits = lambda rule: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*rule.split("/", 1))
    longest = sorted(urlfilter.RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)
    own = f"{_first_like(urlfilter.BLOCKED_HOSTS, 'host')} {_first_like(urlfilter.BLOCKED_PATHS, 'path')}"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {_like(urlfilter.BLOCKED_HOSTS, "host")} OR {_like(urlfilter.BLOCKED_PATHS, "path")} THEN 'block' ELSE 'allow' END AS verdict,
       CASE {rule} {own} END AS reason
FROM parts"""


ORACLES: dict[str, str] = {
    "op2_embeddings": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {embed_dedup.THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.x = v.vec_id""",
    # for messages that are not JSON objects, of which the given tables consist; tool calls are tested on a fixture
    "op8_chat": """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, 0::BIGINT AS n_calls,
       '' AS call_status, NULL::VARCHAR AS link, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS message
FROM conversations""",
    "op10_urls": _urls_sql(),
    # CRC-32 by its table; then what every batch knows, holds and emits, for all batches side by side
    "op11_sales": """
WITH RECURSIVE r(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM r WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM r WHERE k = 8),
d AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
x AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(change_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(t[xor(a, c) % 256 + 1], a // 256)), 4294967295) AS h FROM d, crc),
c AS (SELECT *, least(9, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE) + h % 4 - 19723) * 10 / 152))::BIGINT AS b FROM x),
s AS (SELECT *, row_number() OVER () AS n, least(9, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 10 / 152))::BIGINT AS b FROM sales),
w AS (SELECT k, (SELECT max(sold_at) FROM s WHERE b < k) - INTERVAL 24 HOUR AS ws, (SELECT max(valid_at) FROM c WHERE b < k) - INTERVAL 24 HOUR AS wc FROM range(11) t(k)),
z AS (SELECT k, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h, lag(h) OVER (ORDER BY k) AS before FROM w),
a AS (SELECT c.*, coalesce(valid_at < wc, false) AS late FROM c JOIN z ON z.k = c.b),
o AS (SELECT z.k, a.client_id, valid_at, change_id, balance, op, coalesce(valid_at <= before AND a.b < z.k, false) AS old FROM a JOIN z ON a.b <= z.k WHERE NOT late),
u AS (SELECT * FROM o QUALIFY NOT old OR row_number() OVER (PARTITION BY k, client_id, old ORDER BY valid_at DESC, change_id DESC) = 1),
e AS (SELECT s.*, (SELECT min(k) FROM z WHERE k >= s.b AND (k = 10 OR s.sold_at IS NULL OR s.sold_at < z.h)) AS k FROM s),
g AS (SELECT k, client_id, count(*) AS n_held FROM u GROUP BY ALL),
m AS (SELECT e.n, u.change_id, u.balance, u.op FROM e JOIN u ON u.k = e.k AND u.client_id = e.client_id AND u.valid_at <= e.sold_at
      QUALIFY row_number() OVER (PARTITION BY e.n ORDER BY u.valid_at DESC, u.change_id DESC) = 1)
SELECT 'sale' AS rec, sale_id AS id, e.k AS batch, coalesce(n_held, 0) AS n_held, m.change_id, floor(100 * m.balance + 0.5)::BIGINT AS balance_cents, m.op
FROM e LEFT JOIN g ON g.k = e.k AND g.client_id = e.client_id LEFT JOIN m ON m.n = e.n
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM a WHERE late""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
