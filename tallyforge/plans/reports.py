"""Report grammars over tables and lines that are printed from the orders, so that SQL knows what they must yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import grammar as g
from tallyforge.staging import dealt

SUBJECTS = {"Progress towards achievement of PDO": "PDO", "Overall Implementation Progress": "IP"}
_WORD = "CASE {} WHEN 1 THEN 'Highly Unsatisfactory' WHEN 2 THEN 'Unsatisfactory' WHEN 3 THEN 'Moderately Unsatisfactory' WHEN 4 THEN 'Moderately Satisfactory' WHEN 5 THEN 'Satisfactory' ELSE 'Highly Satisfactory' END"
_RANK = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
_NOW, _BEFORE = _WORD.format(_RANK), _WORD.format(f"1 + ({_RANK} + o_custkey) % 6")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    word = lambda r: F.get(F.array(*map(F.lit, g.RATINGS)), (r - 1).cast("int"))
    # dealt as orders: the rows and lines that are printed of them stay where they are, and no window shuffles them
    o = dealt(table(spark, d, "orders").withColumn("document_id", F.col("o_orderkey")), "document_id")
    o = o.withColumn("day", F.col("o_orderdate").cast("date"))
    return o.withColumn("now", word(rank)).withColumn("before", word(1 + (rank + F.col("o_custkey")) % 6)).withColumn("odd", F.col("o_orderkey") % 2 == 1)


def _rows(o: DataFrame, *rows: tuple[Column | int, int, Column], first: int = 0) -> DataFrame:
    """Rows (page, table_no, row_no, cells); a row with null cells isn't printed."""
    each = F.array(*(F.struct((p if isinstance(p, Column) else F.lit(p)).cast("int").alias("page"), F.lit(t).alias("table_no"), F.lit(i + first).alias("row_no"), c.alias("cells")) for i, (p, t, c) in enumerate(rows)))
    return o.select("document_id", F.explode(each).alias("r")).select("document_id", "r.*").filter("cells is not null")


def _lines(o: DataFrame, *texts: tuple[int, Column]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(p).alias("page"), F.lit(i).alias("line_no"), t.alias("text")) for i, (p, t) in enumerate(texts)))
    return o.select("document_id", F.explode(each).alias("r")).select("document_id", "r.*").filter("text is not null")


def _c(*cells: Column | str) -> Column:
    return F.array(*(c if isinstance(c, Column) else F.lit(c) for c in cells))


def _subjects(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A rating of PDO in a table whose columns change places, one of IP in lines, over a page break in odd documents."""
    odd = F.col("odd")
    rows = _rows(o, (1, 1, F.when(odd, _c("Name", "Current Rating", "Previous Rating")).otherwise(_c("Name", "Previous Rating", "Current Rating"))), (2, 1, F.when(odd, _c("Progress towards achievement of PDO", "now", "before")).otherwise(_c("Progress towards achievement of PDO", "before", "now"))))
    rows = rows.join(o.select("document_id", "now", "before"), "document_id").withColumn("cells", F.transform("cells", lambda c: F.when(c == "now", F.col("now")).when(c == "before", F.col("before")).otherwise(c))).drop("now", "before")
    lines = _lines(o, (1, F.lit("Overall Risk")), (1, F.concat(F.lit("Overall Implementation Progress (IP) "), F.col("before"), F.when(odd, "").otherwise(F.concat(F.lit(" "), F.col("now"))))), (2, F.when(odd, F.col("now")).otherwise("Key Dates")), (2, F.lit("Progress towards achievement of PDO Satisfactory Satisfactory Satisfactory")))
    return rows, lines


@query(
    "report_ratings",
    f"SELECT o_orderkey AS document_id, s.subject, {_BEFORE} AS previous, {_NOW} AS current, s.method FROM orders, (VALUES ('PDO', 'TABLE'), ('IP', 'TEXT')) s(subject, method)",
)
def report_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of tables, and of lines where no table has them."""
    rows, lines = _subjects(_orders(spark, d))
    tables = g.rated_rows(rows, SUBJECTS, {"previous": "previous", "current": "current"})
    return g.preferred(tables, g.rated_lines(lines, SUBJECTS), ["document_id", "subject"], ["previous", "current"])


@query(
    "risk_category_ratings",
    f"SELECT o_orderkey AS document_id, s.subject, {_NOW} AS at_approval, {_BEFORE} AS previous, {_NOW} AS current FROM orders, (VALUES ('POLITICAL'), ('FIDUCIARY')) s(subject)",
)
def risk_category_ratings(spark: SparkSession, d: str) -> DataFrame:
    """A table that goes on after a page break, with a category printed twice."""
    rows = risk_category_rows(_orders(spark, d))
    return g.rated_rows(rows, {"Political": "POLITICAL", "Fiduciary": "FIDUCIARY"}, {"at_approval": "approval", "previous": "previous", "current": "current"}).drop("page")


def risk_category_rows(o: DataFrame) -> DataFrame:
    now, before = F.col("now"), F.col("before")
    return _rows(o, (1, 1, _c("Risk Category", "Rating at Approval", "Previous Rating", "Current Rating")), (1, 1, _c("Political and Governance", now, before, now)), (2, 2, _c(" Fiduciary", now, before, now)), (2, 2, _c("Political and Governance", before, before, before)))


@query(
    "report_key_dates",
    "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey AS document_id, day AS approval, day + 30 AS signing, CASE WHEN o_orderkey % 3 > 0 THEN day + 60 END AS effectiveness, day + 1000 AS original_closing, day + 1400 AS current_closing FROM o",
)
def report_key_dates(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    on = lambda n: F.date_format(F.date_add("day", n), "dd-MMM-yyyy")
    five = F.concat_ws(" ", on(0), on(30), F.when(F.col("o_orderkey") % 3 > 0, on(60)).otherwise("--"), on(1000), on(1400))
    return g.key_dates(_lines(o, (1, F.concat(F.lit("Archived "), on(5))), (1, F.concat(F.lit("Approval "), five)), (2, F.concat_ws(" ", on(1), on(2), on(3), on(4), on(5)))))


@query("report_narratives", "SELECT o_orderkey AS document_id, t.title, CASE t.title WHEN 'DECISIONS' THEN 'order ' || o_orderkey || ' is ' || o_orderstatus ELSE o_orderpriority END AS text FROM orders, (VALUES ('DECISIONS'), ('ISSUES')) t(title)")
def report_narratives(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    lines = _lines(o, (1, F.lit("ISR")), (1, F.lit("Key Decisions Regarding Implementation")), (1, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))), (2, F.concat(F.lit("is "), F.col("o_orderstatus"))), (2, F.lit("Key Issues")), (2, F.col("o_orderpriority")), (3, F.lit("Key Issues")), (3, F.lit("again")))
    return g.narratives(lines, {"DECISIONS": "^Key Decisions", "ISSUES": "^Key Issues"})


@query(
    "report_snapshots",
    f"""WITH l AS (SELECT l_orderkey, count(*) AS loans, CASE WHEN count(*) = count(CASE WHEN l_linenumber < 6 THEN 1 END) THEN sum(CAST(l_extendedprice AS DECIMAL(18,2))) END AS disbursed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS day, 'HEADER' AS basis, 2 * (o_orderkey % 20) AS difference, {_NOW} AS pdo, {_NOW} AS ip, coalesce(loans, 0) AS loans, disbursed, CASE WHEN 2 * (o_orderkey % 20) > 30 THEN 'DATES_DIFFER' END AS issue FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def report_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A report's date, ratings and strict sums in one row, with an issue where its two dates lie over 30 days apart."""
    from tallyforge.functions.records import report_date

    o = _orders(spark, d)
    rows, lines = _subjects(o)
    ratings = g.preferred(g.rated_rows(rows, SUBJECTS, {"previous": "previous", "current": "current"}), g.rated_lines(lines, SUBJECTS), ["document_id", "subject"], ["previous", "current"])
    ratings = ratings.groupBy("document_id").agg(*(F.max(F.when(F.col("subject") == s, F.col("current"))).alias(s.lower()) for s in ("PDO", "IP")))
    amount = F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice").cast("decimal(18,2)"))
    loans = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count(F.lit(1)).alias("loans"), F.when(F.count(F.lit(1)) == F.count(amount), F.sum(amount)).alias("disbursed"))
    dated = o.select("document_id", report_date(F.col("day"), F.date_add("day", (2 * (F.col("o_orderkey") % 20)).cast("int"))).alias("x"))
    out = dated.join(ratings, "document_id", "left").join(loans, "document_id", "left")
    return out.select("document_id", "x.day", "x.basis", F.col("x.difference").cast("long").alias("difference"), "pdo", "ip", F.coalesce("loans", F.lit(0)).alias("loans"), "disbursed", F.when(F.col("x.difference") > 30, "DATES_DIFFER").alias("issue"))


@query(
    "result_rows",
    """SELECT o_orderkey AS document_id, 2 AS page, 'Component ' || o_orderstatus AS grp, 'Roads' AS name, '10|' || o_custkey || '|30|40' AS "values", 'late ' || o_orderkey || ' again' AS comments, 'WIDE' AS kind, 'baseline_value,baseline_date,target_value,target_date' AS roles FROM orders
UNION ALL SELECT o_orderkey, 3, 'Component ' || o_orderstatus, 'Bridges', '1|2|' || o_custkey || '|4', NULL, 'WIDE', 'baseline_value,baseline_date,target_value,target_date' FROM orders""",
)
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two rows of a wide table: group above a page break, comments below a row, and one row's values in one cell."""
    return results_of(wide_result_rows(_orders(spark, d)))


def wide_result_rows(o: DataFrame) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    return _rows(
        o,
        (1, 1, _c(F.concat(F.lit("Component "), F.col("o_orderstatus")), "", "", "", "")),
        (2, 1, _c("Roads", "10", key, "30", "40")),
        (2, 1, _c(F.concat(F.lit("Comments: late "), F.col("o_orderkey").cast("string")), "", "", "", "")),
        (3, 2, _c("Comments again", "", "", "", "")),
        (3, 2, _c("Bridges", "", F.concat(F.lit("1 2  "), key, F.lit(" 4")), "", "")),
    )


def results_of(rows: DataFrame) -> DataFrame:
    top, sub = _c("Baseline", "", "End Target", " "), _c("Value", "Date", "Value", "Date")
    out = g.wide_rows(rows, 4).select("document_id", "page", "grp", "name", F.array_join("values", "|").alias("values"), "comments")
    return out.withColumn("kind", g.table_kind(_c("Indicator", "Baseline", "Target"))).withColumn("roles", F.array_join(g.roles_of_header(top, sub), ","))


@query(
    "result_blocks",
    """SELECT o_orderkey AS document_id, 'People (Number, Custom)' AS name, CASE WHEN o_orderkey % 2 = 0 THEN '0|' || o_custkey || '|2|9' END AS "values", CASE WHEN o_orderkey % 2 = 0 THEN 'a|b|c|d' END AS dates, CASE WHEN o_orderkey % 2 = 1 THEN 'value count' ELSE '' END AS problems, CASE WHEN o_orderkey % 2 = 1 THEN 'AMBIGUOUS' ELSE 'OK' END AS status FROM orders""",
)
def result_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of lines, and their names completed over the lines until a parenthesis closes."""
    o = _orders(spark, d)
    value = F.concat(F.lit("Value 0 "), F.col("o_custkey").cast("string"), F.lit(" 2"), F.when(F.col("odd"), "").otherwise(" 9"))
    lines = _lines(o, (1, F.lit("Results")), (1, F.lit("People (Number,")), (1, F.lit("Custom)")), (2, value), (2, F.lit("Date a b c d")))
    names = g.completed(lines, F.startswith("text", F.lit("People"))).select("document_id", F.col("name").alias("full"))
    found = g.withheld(g.blocks(lines, F.startswith("text", F.lit("People"))), "problems", ["values", "dates"])
    return found.join(names, "document_id").select("document_id", F.col("full").alias("name"), F.array_join("values", "|").alias("values"), F.array_join("dates", "|").alias("dates"), F.array_join("problems", ",").alias("problems"), "status")


@query(
    "chosen_readings",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE max(l_quantity) END AS value, CASE l_linenumber % 4 WHEN 0 THEN 'AGREED' WHEN 1 THEN 'TABLE' WHEN 2 THEN 'TEXT' ELSE 'CONFLICT' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def chosen_readings(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("value"))
    text = lines.filter(n != 1).withColumn("value", F.when(n == 3, F.col("value") + 1).otherwise(F.col("value")))
    return g.chosen(lines.filter(n != 2), text, ["l_orderkey", "l_linenumber"], "value")


@query(
    "appraisal_ratings",
    "SELECT o_custkey, o_orderstatus, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 'OK' ELSE 'CONFLICT' END AS status FROM orders GROUP BY ALL",
)
def appraisal_ratings(spark: SparkSession, d: str) -> DataFrame:
    return g.agreed_rating(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority")


@query(
    "risk_tables",
    """SELECT o_orderkey AS document_id, 1 AS page, 'Risk A of ' || o_orderkey AS description, o_orderpriority || ' more' AS mitigation, 'Fiduciary' AS category, 'Substantial' AS rating FROM orders
UNION ALL SELECT o_orderkey, 2, 'Risk B', o_orderstatus, 'Fiduciary', 'Substantial' FROM orders WHERE o_orderkey % 2 = 0""",
)
def risk_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table that goes on where the next page has one of the same width, a fragment row, and the section's title."""
    return risks_of(risk_rows(_orders(spark, d)))


def risk_rows(o: DataFrame) -> DataFrame:
    gap = F.when(F.col("odd"), 4).otherwise(2)
    return _rows(o, (1, 1, _c("Risk description", "Mitigation measures")), (1, 1, _c(F.concat(F.lit("Risk A of "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"))), (1, 1, _c("", "more")), (gap, 2, _c("Risk B", F.col("o_orderstatus"))), (gap, 3, _c("x", "y", "z")))


def risks_of(rows: DataFrame) -> DataFrame:
    found = g.continued(rows, {"description": "(?i)risk", "mitigation": "(?i)mitigation"}).drop("row_no")
    return found.withColumn("t", g.titled_risk(F.lit("Fiduciary Risks (Substantial)"))).select("document_id", "page", "description", "mitigation", "t.category", "t.rating")


_EVENTS = "CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED' WHEN o_orderkey % 3 = 1 THEN 'FLAG_ONLY' ELSE 'CONFLICT' END"


@query(
    "paper_events",
    f"""SELECT o_orderkey AS document_id, 'CLOSING_DATE' AS type, {_EVENTS} AS status FROM orders UNION ALL SELECT o_orderkey, 'CANCELLATION', CASE WHEN o_orderkey % 2 = 0 THEN 'TABLE_ONLY' ELSE 'FLAG_ONLY' END FROM orders""",
)
def paper_events(spark: SparkSession, d: str) -> DataFrame:
    """Flags as Yes/No and as ticks, and what the tables of the paper show."""
    o = _orders(spark, d)
    return events_of(o, change_rows(o))


def change_rows(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return _rows(o, (1, 1, _c("Change in Closing Date", F.when(k % 3 < 2, "Yes").otherwise("No"), "")), (1, 1, F.when(k % 2 == 0, _c("Cancellation of Loan", "", "")).otherwise(_c("Cancellation of Loan", "✔", ""))), (2, 1, _c("Cancellation of Loan", "✔", "✔")))


def events_of(o: DataFrame, rows: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    flags = g.change_flags(rows, {"Change in Closing": "CLOSING_DATE", "Cancellation": "CANCELLATION"})
    found = o.select("document_id", F.explode(F.array_compact(F.array(F.when(k % 3 != 1, "CLOSING_DATE"), F.when(k % 2 == 0, "CANCELLATION")))).alias("type"))
    return g.flagged_events(flags, found)


@query(
    "closing_changes",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE o_orderdate END AS DATE) AS old_closing, CAST(l_shipdate AS DATE) + 100 AS new_closing, CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS cancelled, CASE WHEN l_discount > 0.05 THEN CAST(l_shipdate AS DATE) END AS value_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def closing_changes(spark: SparkSession, d: str) -> DataFrame:
    """A loan's closing row: the old date is the current one, else the original; an amount of zero cancels nothing."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    current = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).cast("date")
    amount = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0).cast("decimal(18,2)")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(current, F.col("o_orderdate").cast("date")).alias("old_closing"), F.date_add(F.col("l_shipdate").cast("date"), 100).alias("new_closing"), F.when(amount != 0, amount).alias("cancelled"), F.when(amount != 0, F.col("l_shipdate").cast("date")).alias("value_date"))


@query(
    "rendered_tables",
    "SELECT l_orderkey AS document_id, 1 AS page, 1 AS table_no, string_agg('Line: ' || l_linenumber || CASE WHEN l_returnflag = 'N' THEN '' ELSE '; Flag: ' || l_returnflag END, chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_orderkey",
)
def rendered_tables(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    body = lines.select("document_id", F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.col("l_linenumber").alias("row_no"), F.array(F.col("l_linenumber").cast("string"), F.when(F.col("flag") == "N", " ").otherwise(F.col("flag"))).alias("cells"))
    head = lines.select("document_id").distinct().select("document_id", F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), _c("Line", "Flag").alias("cells"))
    return g.rendered(head.unionByName(body))


@query(
    "text_coverage",
    "WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, n_chars // 2)), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM documents) SELECT doc_id, CASE WHEN len(b) = 0 THEN 1.0 ELSE round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(b), 4) END AS coverage FROM t",
)
def text_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of a text its first half covers."""
    pages = table(spark, d, "documents").withColumn("half", F.substr("text", F.lit(1), F.floor(F.col("n_chars") / 2).cast("int")))
    return pages.select("doc_id", g.coverage(pages, "half", "text").alias("coverage"))


@query(
    "derived_events",
    f"""WITH r AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, {_RANK} AS rank, lag({_RANK}) OVER w AS before, lead(CAST(o_orderdate AS DATE)) OVER w AS next_day FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, before, rank, day, next_day AS candidate_date, CASE WHEN next_day IS NULL THEN 'NONE' ELSE 'CANDIDATE' END AS candidate_status FROM r WHERE before IS NOT NULL AND before <> rank""",
)
def derived_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that follow from what changes between consecutive reports; the next report's date is a candidate only."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _orders(spark, d).withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = o.select("o_custkey", "o_orderkey", F.lag("rank").over(w).alias("before"), "rank", "day", F.lead("day").over(w).alias("candidate_date"))
    return rows.filter("before is not null and before <> rank").withColumn("candidate_status", F.when(F.col("candidate_date").isNull(), "NONE").otherwise("CANDIDATE"))
