"""Scalar functions over text, numbers, dates, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.functions import dates, numbers, text
from tallyforge.plans.common import observed


@query("collapsed_text", "SELECT doc_id, sha256(nullif(trim(regexp_replace(text, '[\\s ]+', ' ', 'g')), '')) AS h FROM documents")
def collapsed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("h"))


@query(
    "html_text",
    r"""SELECT page_id, sha256(nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s """ + " " + r"""]+', ' ', 'g')), '')) AS h FROM pages""",
)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("h"))


@query("identifiers", r"SELECT c_custkey, CASE WHEN regexp_matches(trim(regexp_replace(c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN ' x' ELSE '  ' END, '\s+', ' ', 'g')), '\s') THEN NULL ELSE upper(trim(c_mktsegment)) END AS id FROM customer")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, " x").otherwise("  "))
    return table(spark, d, "customer").select("c_custkey", text.identifier(raw, upper=True).alias("id"))


@query("decimal_words", r"SELECT p_partkey, coalesce(regexp_replace(regexp_replace(CAST(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,4)) END AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', ''), 'not stated') AS price FROM part")
def decimal_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.decimal_text(F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice").cast("decimal(18,4)"))).alias("price"))


@query("line_signatures", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT lower(regexp_replace(line, '\d+', '#', 'g')) AS signature, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def line_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Repeated furniture: lines whose masked form stands in at least three documents."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy(text.line_signature(F.col("line")).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).filter("docs >= 3")


@query("alphanumeric_text", "SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS h FROM documents")
def alphanumeric_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.alphanumeric(F.col("text")), 256).alias("h"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = rf"""list_filter(flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+(?:[./-][a-z0-9]+)*'), lambda t: CASE WHEN regexp_matches(t, '[./-]') THEN [t] || regexp_split_to_array(t, '[./-]') ELSE [t] END)), lambda t: t NOT IN ({_STOP}))"""


@query("search_tokens", f"SELECT item_id, len({TOKENS}) AS n, sha256(array_to_string({TOKENS}, ' ')) AS h FROM benchmark")
def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", text.search_tokens(F.col("text")).alias("t"))
    return rows.select("item_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("h"))


@query("token_overlap", f"WITH t AS (SELECT item_id, list_distinct({TOKENS}) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)), 6) AS jaccard FROM t a JOIN t b ON a.item_id + 1 = b.item_id")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark").select("item_id", text.search_tokens(F.col("text")).alias("t"))
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, F.col("a.item_id") + 1 == F.col("b.item_id")).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(text.jaccard(F.col("a.t"), F.col("b.t")), 6).alias("jaccard"))


@query("printed_numbers", r"WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_linenumber WHEN 1 THEN '1,234.50' WHEN 2 THEN '12.1234567' WHEN 3 THEN 'n/a' WHEN 4 THEN '1,23' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS s FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN regexp_matches(s, '^\s*-?(\d{1,3}(,\d{3})+|\d+)(\.\d{1,6})?\s*$') THEN CAST(CAST(replace(s, ',', '') AS DECIMAL(38,6)) AS VARCHAR) END AS number FROM x")
def printed_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    raw = F.when(n == 1, "1,234.50").when(n == 2, "12.1234567").when(n == 3, "n/a").when(n == 4, "1,23").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", numbers.printed_number(raw).cast("string").alias("number"))


@query("numeric_tolerance", "SELECT o_orderkey, abs(o_totalprice - t) <= 0.005 * greatest(abs(o_totalprice), abs(t)) AS near FROM orders JOIN (SELECT l_orderkey, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE, 2) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def numeric_tolerance(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("t"))
    return table(spark, d, "orders").join(t, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", numbers.within(F.col("o_totalprice"), F.col("t")).alias("near"))


@query("parsed_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 1 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "d-MMM-yyyy")).when(k == 1, F.date_format("o_orderdate", "MMM/yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", dates.day_or_month_end(raw).alias("day"))


@query("declared_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def declared_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("31/31/2020")
    return table(spark, d, "orders").select("o_orderkey", dates.first_date(raw, ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("day"))


@query("elapsed_shares", "SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) * 100 AS DOUBLE) / 365, 2) AS share, CAST(o_orderdate AS DATE) BETWEEN DATE '1944-07-01' AND DATE '2100-12-31' AS plausible FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def elapsed_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    start = F.col("o_orderdate").cast("date")
    share = dates.elapsed_share(start, F.col("l_shipdate").cast("date"), F.date_add(start, 365)).cast("double")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", share.alias("share"), dates.plausible(start).alias("plausible"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS mirrored FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(numbers.dot(v, v)), 6).alias("norm"), F.round(numbers.dot(v, F.reverse(v)), 6).alias("mirrored"))


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("array_sets", "WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS a, list_sort(list_distinct(list(CAST(l_suppkey % 7 AS INTEGER)))) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(a, ',') AS lines, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_, CAST(len(b) AS INTEGER) AS n, list_contains(b, 3) AS has_three FROM o")
def array_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("a"), F.array_sort(F.collect_set((F.col("l_suppkey") % 7).cast("int"))).alias("b"))
    return o.select("l_orderkey", F.array_join("a", ",").alias("lines"), F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both_"), F.size("b").alias("n"), F.array_contains("b", 3).alias("has_three"))


@query("record_keys", "SELECT o_orderkey, substr(sha256('orders' || chr(31) || o_orderkey || chr(31) || coalesce(CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END, '␀')), 1, 32) AS record_id FROM orders")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.record_key(F.lit("orders"), F.col("o_orderkey"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))).alias("record_id"))


@query("ordered_classification", r"SELECT page_id, CASE WHEN regexp_matches(url, '\.html') THEN 'HTML' WHEN regexp_matches(url, '[?&]utm_') THEN 'CAMPAIGN' WHEN regexp_matches(url, '#') THEN 'ANCHOR' ELSE 'UNKNOWN' END AS kind, regexp_extract(html, '<html lang=.([a-z]+)', 1) AS lang, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages")
def ordered_classification(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    kind = F.when(url.rlike(r"\.html"), "HTML").when(url.rlike("[?&]utm_"), "CAMPAIGN").when(url.contains("#"), "ANCHOR").otherwise("UNKNOWN")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"), F.regexp_extract("html", "<html lang=.([a-z]+)", 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


@query("sections_carried", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), h AS (SELECT doc_id, pos, CASE WHEN length(line) BETWEEN 1 AND 30 THEN pos END AS head FROM l) SELECT doc_id, coalesce(last_head, 0) AS section, count(*) AS lines FROM (SELECT doc_id, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS last_head FROM h) GROUP BY ALL")
def sections_carried(spark: SparkSession, d: str) -> DataFrame:
    """A short line opens a section that lasts until the next one."""
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("head", F.when(F.length("line").between(1, 30), F.col("at") + 1))
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("doc_id", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit(0)).cast("long").alias("section"))
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"))


@query("enum_titles", "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN '1 Urgent' WHEN '2-HIGH' THEN '2 High' WHEN '3-MEDIUM' THEN '3 Medium' WHEN '4-NOT SPECIFIED' THEN '4 Not Specified' WHEN '5-LOW' THEN '5 Low' END AS title, count(*) AS n FROM orders GROUP BY 1")
def enum_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.first(text.title_case(F.col("o_orderpriority"))).alias("title"), F.count(F.lit(1)).alias("n"))


@query(
    "dehyphenated_text",
    r"""SELECT doc_id, sha256(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g')) AS joined, len(text) AS n FROM documents""",
)
def dehyphenated_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose words are split by a hyphen and a line's end before each inner e, and joined again."""
    split = F.regexp_replace("text", r"(?<=[a-z])e(?=[a-z])", "-\ne")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.dehyphenated(split), 256).alias("joined"), F.length("text").cast("long").alias("n"))
