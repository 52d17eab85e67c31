"""Grammars over markup: pages cut into blocks, and tables that are printed as loose HTML and read from it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import query, sql_of, table
from tallyforge.operators import grammar as g
from tallyforge.operators import machines, markup
from tallyforge.plans import reports as rep

_BLOCK = ", ".join(f"'{t}'" for t in markup.BLOCK_TAGS)
_TOKENS = r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>|[^<]+"


@query(
    "page_blocks",
    f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '{_TOKENS}') AS t FROM pages), t AS (SELECT page_id, unnest(t) AS tok, unnest(range(len(t))) AS i FROM x),
k AS (SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM t WHERE tok NOT LIKE '<!%' AND NOT regexp_matches(tok, '^<(script|style)')),
n AS (SELECT *, sum(CASE WHEN tag IN ({_BLOCK}) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS nth FROM k),
b AS (SELECT page_id, nth, coalesce(max(CASE WHEN tag IN ({_BLOCK}) AND tok NOT LIKE '</%' THEN tag END), 'text') AS kind, string_agg(CASE WHEN tok LIKE '<%' THEN '' ELSE tok END, '' ORDER BY i) AS text FROM n GROUP BY ALL),
d AS (SELECT page_id, nth, kind, trim(regexp_replace(replace(replace(replace(replace(text, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '[\\s ]+', ' ', 'g')) AS text FROM b)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nth) AS block_no, kind, text FROM d WHERE text <> ''""",
)
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every page's runs of text with the tag that opens them."""
    return markup.blocks(table(spark, d, "pages"), "page_id", "html")


@query(
    "page_sections",
    f"""WITH blocks AS ({sql_of("page_blocks")}), s AS (SELECT *, kind = 'h1' AS is_heading, kind = 'footer' AS furniture FROM blocks),
n AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER w AS nth, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER w AS title FROM s WINDOW w AS (PARTITION BY page_id ORDER BY block_no))
SELECT page_id AS document_id, block_no, is_heading, CASE WHEN NOT furniture THEN nth END AS section_no, CASE WHEN NOT furniture THEN coalesce(title, 'FRONT_MATTER') END AS section FROM n""",
)
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section of every block: headings are carried on, footers are in none."""
    rows = page_blocks(spark, d).select(F.col("page_id").alias("document_id"), "block_no", (F.col("block_no") - 1).alias("place"), "kind", "text")
    found = machines.in_sections(rows, F.col("kind") == "h1", F.col("kind") == "footer")
    return found.select("document_id", "block_no", "is_heading", "section_no", "section")


#: Rows that a task prints and reads again, about.
PRINTED = 100_000


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def printed(rows: DataFrame) -> DataFrame:
    """(document_id, html) of rows (document_id, page, table_no, row_no, cells), loosely: end tags of cells and rows are left
    out in documents with an odd id, tables of others have sections, and a stray end tag and a comment stand around."""
    lone = F.col("document_id") % 2 == 1
    # a number of tasks that follows the rows: little that is shuffled makes much markup
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PRINTED))
    r = rows.repartition(tasks, "document_id").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "table_no", "row_no", "cells"))).alias("r"))

    def one(x: Column, i: Column) -> Column:
        same = lambda y: (y["page"] == x["page"]) & (y["table_no"] == x["table_no"])
        first = (i == 0) | ~same(F.get("r", i - 1))
        last = F.coalesce(~same(F.get("r", i + 1)), F.lit(True))
        cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(_escaped(c), F.lit("")), F.when(lone, "").otherwise(" </TD>"))
        opened = F.concat(F.lit("<div data-page='"), x["page"].cast("string"), F.lit("'></td><!-- <td> --><p>Table<table class=\"a>b\">"), F.when(lone, "").otherwise("<tbody>"))
        closed = F.when(lone, "</table>").otherwise("</tbody></table></div>")
        row = F.concat(F.lit("<tr>"), F.array_join(F.transform(x["cells"], cell), "\n"), F.when(lone, "").otherwise("</tr>"))
        return F.concat(F.when(first, opened).otherwise(""), row, F.when(last, closed).otherwise(""))

    return r.select("document_id", F.array_join(F.transform("r", one), "").alias("html"))


def reread(rows: DataFrame) -> DataFrame:
    """The same rows after printing and parsing."""
    return markup.read_rows(printed(rows), "document_id", "html")


@query(
    "parsed_cells",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS row_no FROM lineitem),
c AS (SELECT l_orderkey AS document_id, 1 + row_no AS row_no, unnest([1, 2, 3]) AS cell_no, unnest([l_linenumber::VARCHAR, 'a<b & ' || l_returnflag, CASE WHEN l_returnflag = 'N' THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END]) AS text FROM l
UNION ALL SELECT DISTINCT l_orderkey, 1, unnest([1, 2, 3]), unnest(['Line', 'Flag', 'Quantity']) FROM lineitem)
SELECT document_id, CAST(1 + document_id % 3 AS INTEGER) AS page, 1::BIGINT AS table_no, row_no::BIGINT AS row_no, cell_no::BIGINT AS cell_no, cell_no::BIGINT AS column_no, false AS is_head, 1 AS colspan, 1 AS rowspan, text FROM c""",
)
def parsed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every order as cells of a printed table."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice"))
    lines = table(spark, d, "lineitem").withColumn("row_no", nth)
    page = (1 + F.col("l_orderkey") % 3).cast("int").alias("page")
    quantity = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_quantity").cast("long").cast("string"))
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("a<b & "), F.col("l_returnflag")), quantity)
    body = lines.select(F.col("l_orderkey").alias("document_id"), page, F.lit(1).alias("table_no"), "row_no", cells.alias("cells"))
    head = lines.select(F.col("l_orderkey").alias("document_id"), page).distinct().select("*", F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.array(*map(F.lit, ("Line", "Flag", "Quantity"))).alias("cells"))
    return markup.cells(printed(head.unionByName(body)), "document_id", "html")


@query("parsed_risk_ratings", sql_of("risk_category_ratings"))
def parsed_risk_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings by category, read from markup."""
    rows = reread(rep.risk_category_rows(rep._orders(spark, d)))
    return g.rated_rows(rows, {"Political": "POLITICAL", "Fiduciary": "FIDUCIARY"}, {"at_approval": "approval", "previous": "previous", "current": "current"}).drop("page")


@query("parsed_result_rows", sql_of("result_rows"))
def parsed_result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a wide results table with groups and comments, read from markup."""
    return rep.results_of(reread(rep.wide_result_rows(rep._orders(spark, d))))


@query("parsed_risk_tables", sql_of("risk_tables"))
def parsed_risk_tables(spark: SparkSession, d: str) -> DataFrame:
    """Risk tables that go on over pages, read from markup."""
    return rep.risks_of(reread(rep.risk_rows(rep._orders(spark, d))))


@query("parsed_paper_events", sql_of("paper_events"))
def parsed_paper_events(spark: SparkSession, d: str) -> DataFrame:
    """Flags of change papers, read from markup."""
    o = rep._orders(spark, d)
    return rep.events_of(o, reread(rep.change_rows(o)))


_SEQ = "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders)"


@query(
    "block_readings",
    f"""{_SEQ}
SELECT o_custkey AS document_id, 8 * n + 1 AS place, CAST(n // 3 AS INTEGER) + 1 AS page, CASE WHEN o_orderkey % 7 = 4 THEN '► People ' || o_orderkey || ' (Number, Custom)' ELSE '► People ' || o_orderkey END AS name,
  CASE WHEN o_orderkey % 7 NOT IN (1, 2, 6) THEN '0 ' || o_custkey || ' 2 9' END AS "values", CASE WHEN o_orderkey % 7 NOT IN (1, 5) THEN 'a b c d' END AS dates, CASE WHEN o_orderkey % 7 NOT IN (1, 5) THEN 'late again' END AS comments,
  CASE o_orderkey % 7 WHEN 1 THEN 'no values,no dates,date out of place' WHEN 2 THEN 'values count' WHEN 5 THEN 'no dates' WHEN 6 THEN 'values twice' ELSE '' END AS problems
FROM o WHERE o_orderkey % 7 <> 3""",
)
def block_readings(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a customer's lines: whole ones, wrapped names, orphans after a heading, values that are missing, doubled or
    too few, and dates before values."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    k = F.col("o_orderkey") % 7
    o = table(spark, d, "orders").withColumn("n", n)
    name = F.concat(F.lit("► People "), F.col("o_orderkey").cast("string"))
    value = F.concat(F.lit("Value 0 "), F.col("o_custkey").cast("string"), F.lit(" 2"), F.when(k == 2, "").otherwise(" 9"))
    texts = (
        F.lit("Results"),
        F.when(k != 3, name),
        F.when(k == 4, "(Number, Custom)"),
        F.when(k != 1, value),
        F.when(k == 6, value),
        F.when(k != 5, "Date a b c d"),
        F.when(k != 5, "late"),
        F.when(k != 5, "again"),
    )
    each = F.array(*(F.struct((8 * F.col("n") + i).cast("long").alias("place"), (F.floor(F.col("n") / 3) + 1).cast("int").alias("page"), t.alias("text")) for i, t in enumerate(texts)))
    lines = o.select(F.col("o_custkey").alias("document_id"), F.inline(each)).filter("text is not null")
    found = machines.block_readings(lines, "^►", "^Results")
    return found.withColumn("values", F.array_join("values", " ")).withColumn("dates", F.array_join("dates", " ")).withColumn("problems", F.array_join("problems", ","))


@query(
    "numbered_blocks",
    f"""{_SEQ}, b AS (SELECT * FROM o WHERE n % 2 = 0) SELECT o_custkey AS document_id, 4 * n AS place, 'Risk ' || o_orderkey AS description, o_orderpriority AS rating,
  o_orderstatus || ' more of ' || o_orderkey || CASE WHEN EXISTS (SELECT 1 FROM o x WHERE x.o_custkey = b.o_custkey AND x.n = b.n + 1) THEN ' then ' || (SELECT x.o_orderkey FROM o x WHERE x.o_custkey = b.o_custkey AND x.n = b.n + 1) ELSE '' END AS mitigation FROM b""",
)
def numbered_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered risks over several lines; every second order's line goes on with the mitigation of the one before."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    o = table(spark, d, "orders").withColumn("n", n)
    key = F.col("o_orderkey").cast("string")
    even = lambda c: F.when(F.col("n") % 2 == 0, c)
    texts = (
        even(F.concat((F.col("n") + 1).cast("string"), F.lit(". Risk "), key)),
        even(F.concat(F.lit("Rating: "), F.col("o_orderpriority"))),
        even(F.concat(F.lit("Mitigation: "), F.col("o_orderstatus"))),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("more of "), key)).otherwise(F.concat(F.lit("then "), key)),
    )
    each = F.array(*(F.struct((4 * F.col("n") + i).cast("long").alias("place"), t.alias("text")) for i, t in enumerate(texts)))
    lines = o.select(F.col("o_custkey").alias("document_id"), F.inline(each)).filter("text is not null")
    return machines.numbered_blocks(lines, F.col("text").rlike(r"^\d+\. "), {"description": r"^\d+\.\s*", "rating": r"^Rating:\s*", "mitigation": r"^Mitigation:\s*"})
