"""Silver records of loans and awards, and the checks of sources and of Silver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.catalog import query, table
from tallyforge.operators import quality as qa
from tallyforge.operators.aggregates import strict_sum

M = "decimal(18,2)"


@query("theme_nodes", "SELECT p_type, p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS refs, CASE WHEN count(DISTINCT p_name) = 1 THEN min(p_name) END AS p_name, count(DISTINCT p_name) > 1 AS conflict FROM part GROUP BY ALL")
def theme_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("ref", F.col("p_size").cast("string"))
    return qa.theme_nodes(rows, ["p_type", "p_brand"], "p_name", "ref").withColumn("refs", F.array_join("refs", ","))


@query(
    "silver_loans",
    """WITH l AS (SELECT l_orderkey, count(*) AS components, CASE WHEN count(*) = count(CASE WHEN l_tax > 0 THEN 1 END) THEN sum(CAST(l_extendedprice AS DECIMAL(18,2))) END AS principal, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS cancelled, sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS disbursed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS loan_id, o_custkey AS project_id, components, CAST(principal AS DECIMAL(38,2)) AS principal, CAST(cancelled AS DECIMAL(38,2)) AS cancelled, CAST(disbursed AS DECIMAL(38,2)) AS disbursed, CAST(principal - cancelled AS DECIMAL(38,2)) AS net, CASE WHEN principal - cancelled <> 0 THEN round(CAST(disbursed AS DOUBLE) * 100 / CAST(principal - cancelled AS DOUBLE), 2) END AS disbursed_percentage, CASE WHEN principal IS NULL THEN 'PARTIAL' WHEN components IS NULL THEN 'MISSING' ELSE 'COMPLETE' END AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def silver_loans(spark: SparkSession, d: str) -> DataFrame:
    """Loans with their sums: a principal of which a component is unknown is unknown, and so is what follows from it."""
    price = F.col("l_extendedprice").cast(M)
    of = lambda c: F.sum(F.when(c, price).otherwise(F.lit(0).cast(M))).cast("decimal(38,2)")
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("components"), strict_sum(F.when(F.col("l_tax") > 0, price)).cast("decimal(38,2)").alias("principal"), of(F.col("l_returnflag") == "R").alias("cancelled"), of(F.col("l_linestatus") == "F").alias("disbursed"))
    rows = table(spark, d, "orders").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    net = (F.col("principal") - F.col("cancelled")).cast("decimal(38,2)")
    share = F.round(F.try_divide(F.col("disbursed").cast("double") * 100, net.cast("double")), 2)
    status = F.when(F.col("principal").isNull(), "PARTIAL").when(F.col("components").isNull(), "MISSING").otherwise("COMPLETE")
    return rows.select(F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("project_id"), "components", "principal", "cancelled", "disbursed", net.alias("net"), share.alias("disbursed_percentage"), status.alias("status"))


@query(
    "source_issues",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, code, severity FROM orders LEFT JOIN customer ON c_custkey = o_custkey, (VALUES ('REQUIRED_BLANK', 'ERROR'), ('UNPARSABLE_DATE', 'ERROR'), ('NEGATIVE_AMOUNT', 'ERROR'), ('REGISTRY_MISMATCH', 'WARNING'), ('UNRECOGNISED_NOTATION', 'WARNING'), ('BROKEN_REFERENCE', 'ERROR'), ('OPTIONAL_BLANK', 'INFO')) v(code, severity)
WHERE CASE code WHEN 'REQUIRED_BLANK' THEN o_orderkey % 97 = 0 WHEN 'UNPARSABLE_DATE' THEN o_orderkey % 89 = 0 WHEN 'NEGATIVE_AMOUNT' THEN o_totalprice < 0 WHEN 'REGISTRY_MISMATCH' THEN c_acctbal < 0 WHEN 'UNRECOGNISED_NOTATION' THEN o_orderkey % 83 = 0 WHEN 'BROKEN_REFERENCE' THEN c_custkey IS NULL ELSE o_orderpriority = '4-NOT SPECIFIED' END""",
)
def source_issues(spark: SparkSession, d: str) -> DataFrame:
    """Checks of single values of a source, which is printed with defects here, and of its references, in one pass."""
    from tallyforge.functions.dates import first_date
    from tallyforge.functions.records import loan_number

    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    raw = rows.select("*", F.when(i % 97 > 0, F.col("o_orderstatus")).otherwise("  ").alias("state"), F.when(i % 89 > 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("31/31/1996").alias("day"), F.when(i % 83 > 0, F.concat(F.lit("IBRD"), F.lpad((i % 100_000).cast("string"), 5, "0"))).otherwise("P-12").alias("loan"))
    return qa.found(
        raw,
        i,
        {
            "REQUIRED_BLANK": F.trim("state") == "",
            "UNPARSABLE_DATE": first_date(F.col("day"), ("MM/dd/yyyy", "yyyy-MM-dd")).isNull(),
            "NEGATIVE_AMOUNT": F.col("o_totalprice") < 0,
            "REGISTRY_MISMATCH": F.col("c_acctbal") < 0,
            "UNRECOGNISED_NOTATION": loan_number(F.col("loan"))["notation"].isNull(),
            "BROKEN_REFERENCE": F.col("c_custkey").isNull(),
            "OPTIONAL_BLANK": F.col("o_orderpriority") == "4-NOT SPECIFIED",
        },
    )


@query(
    "loan_issues",
    """WITH p AS (SELECT o_custkey, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS key, code, severity FROM customer LEFT JOIN p ON o_custkey = c_custkey, (VALUES ('SEVERAL_LOANS', 'INFO'), ('SEVERAL_SNAPSHOT_DATES', 'WARNING'), ('NO_COVERAGE', 'INFO')) v(code, severity) WHERE CASE code WHEN 'SEVERAL_LOANS' THEN n > 1 WHEN 'SEVERAL_SNAPSHOT_DATES' THEN days > 1 ELSE n IS NULL END""",
)
def loan_issues(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("o_orderdate").cast("date")).alias("days"))
    rows = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return qa.found(rows, F.col("c_custkey"), {"SEVERAL_LOANS": F.col("n") > 1, "SEVERAL_SNAPSHOT_DATES": F.col("days") > 1, "NO_COVERAGE": F.col("n").isNull()})


@query(
    "contract_issues",
    "SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, count(*) AS n, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers, CASE WHEN count(DISTINCT CAST(l_extendedprice AS DECIMAL(18,2))) > 1 THEN 'AMOUNT_COLUMNS_DIFFER' END AS code FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def contract_issues(spark: SparkSession, d: str) -> DataFrame:
    """Contracts on several rows, with their suppliers, and whether their amounts agree."""
    per = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"), F.count_distinct(F.col("l_extendedprice").cast(M)).alias("k"))
    return per.filter("n > 1").select("l_partkey", "day", "n", "suppliers", F.when(F.col("k") > 1, "AMOUNT_COLUMNS_DIFFER").alias("code"))


@query(
    "commitments_compared",
    "WITH l AS (SELECT l_orderkey, CASE WHEN count(*) = count(CASE WHEN l_discount > 0 THEN 1 END) THEN sum(CAST(l_extendedprice AS DECIMAL(18,2))) END AS loans FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN loans IS NULL THEN 'COMMITMENT_NOT_COMPARABLE' WHEN abs(CAST(o_totalprice AS DECIMAL(18,2)) - loans) > 0.01 THEN 'COMMITMENT_DIFFERS' END AS code FROM orders LEFT JOIN l ON l_orderkey = o_orderkey",
)
def commitments_compared(spark: SparkSession, d: str) -> DataFrame:
    loans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(strict_sum(F.when(F.col("l_discount") > 0, F.col("l_extendedprice").cast(M))).alias("loans"))
    rows = table(spark, d, "orders").join(loans, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", qa.commitment(F.col("o_totalprice").cast(M), F.col("loans")).alias("code"))


@query(
    "document_issues",
    """WITH s AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(doc_id AS VARCHAR) AS key, code, severity FROM documents JOIN s ON sha256(text) = h, (VALUES ('IDENTICAL_CONTENT', 'WARNING'), ('UNCLASSIFIED', 'INFO'), ('SIZE_CHANGED', 'WARNING'), ('REQUIRED_BLANK', 'ERROR')) v(code, severity) WHERE CASE code WHEN 'IDENTICAL_CONTENT' THEN n > 1 WHEN 'UNCLASSIFIED' THEN source IS NULL OR lang IS NULL WHEN 'SIZE_CHANGED' THEN length(text) <> n_chars ELSE trim(text) = '' END""",
)
def document_issues(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    same = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = docs.join(same, "h", "left")
    return qa.found(rows, F.col("doc_id"), {"IDENTICAL_CONTENT": F.col("n") > 1, "UNCLASSIFIED": F.col("source").isNull() | F.col("lang").isNull(), "SIZE_CHANGED": F.length("text") != F.col("n_chars"), "REQUIRED_BLANK": F.trim("text") == ""})


@query("metadata_gaps", "SELECT * FROM (SELECT 'lang' AS \"column\", count(*) FILTER (doc_id % 11 = 0) AS n, min(doc_id) FILTER (doc_id % 11 = 0) AS first_key FROM documents UNION ALL SELECT 'source', count(*) FILTER (doc_id % 13 = 0), min(doc_id) FILTER (doc_id % 13 = 0) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars IS NULL), min(doc_id) FILTER (n_chars IS NULL) FROM documents) WHERE n > 0")
def metadata_gaps(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.when(i % 11 > 0, F.col("lang")).otherwise(" ").alias("lang"), F.when(i % 13 > 0, F.lit("s")).alias("source"), "n_chars")
    return qa.metadata_gaps(docs, "doc_id", ["lang", "source", "n_chars"])


@query(
    "silver_issues",
    """WITH l AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_ship, sum(CAST(l_quantity AS BIGINT)) AS q, count(DISTINCT l_linenumber) AS lines, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS key, code, severity FROM orders LEFT JOIN l ON l_orderkey = o_orderkey, (VALUES ('DUPLICATE_ID', 'ERROR'), ('DATE_ORDER', 'ERROR'), ('COMPONENT_DIFFERENCE', 'WARNING'), ('NO_COVERAGE', 'INFO')) v(code, severity) WHERE CASE code WHEN 'DUPLICATE_ID' THEN n > lines WHEN 'DATE_ORDER' THEN first_ship < CAST(o_orderdate AS DATE) WHEN 'COMPONENT_DIFFERENCE' THEN q > 40 * n ELSE n IS NULL END""",
)
def silver_issues(spark: SparkSession, d: str) -> DataFrame:
    """Checks of Silver loans: grain, order of the known dates, components against their sum, coverage."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("first_ship"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count_distinct("l_linenumber").alias("lines"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "orders").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    in_order = qa.ordered_dates(F.col("o_orderdate").cast("date"), F.col("first_ship"))
    return qa.found(rows, F.col("o_orderkey"), {"DUPLICATE_ID": F.col("n") > F.col("lines"), "DATE_ORDER": ~in_order, "COMPONENT_DIFFERENCE": F.col("q") > 40 * F.col("n"), "NO_COVERAGE": F.col("n").isNull()})


@query(
    "parsing_report",
    "SELECT source, lang, count(*) AS documents, sum(n_chars) AS chars, round(avg(n_chars), 2) AS mean_chars, max(n_chars) AS longest, count(*) FILTER (n_chars < 200) AS short, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY source, lang",
)
def parsing_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_distinct(F.sha2("text", 256)).alias("contents"))


_IND = "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) || ' (Number)' WHEN event_id % 3 = 1 THEN event_type ELSE event_type || 's' END AS printed, event_type AS key FROM events"


@query(
    "indicator_identity",
    f"""WITH i AS ({_IND}) SELECT event_id, CASE WHEN event_id % 3 = 2 AND key <> 'click' THEN NULL ELSE key END AS indicator_key, CASE WHEN event_id % 3 < 2 THEN 'EXACT_NAME' WHEN key = 'click' THEN 'ALIAS' ELSE 'PENDING' END AS identity_basis FROM i""",
)
def indicator_identity(spark: SparkSession, d: str) -> DataFrame:
    """A printed indicator is known by its exact name, else by an alias; else it waits for review."""
    from tallyforge.functions.records import indicator_name

    e = table(spark, d, "events")
    printed = F.when(F.col("event_id") % 3 == 0, F.concat(F.upper("event_type"), F.lit(" (Number)"))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.col("event_type"), F.lit("s")))
    names = e.select(F.col("event_type").alias("known")).distinct()
    aliases = F.create_map(F.lit("clicks"), F.lit("click"))
    rows = e.select("event_id", indicator_name(printed)["name"].alias("name")).join(F.broadcast(names), F.col("name") == F.col("known"), "left")  # a row for each kind of event
    alias = aliases[F.col("name")]
    basis = F.when(F.col("known").isNotNull(), "EXACT_NAME").when(alias.isNotNull(), "ALIAS").otherwise("PENDING")
    return rows.select("event_id", F.coalesce("known", alias).alias("indicator_key"), basis.alias("identity_basis"))


@query(
    "match_candidates",
    "WITH k AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL) SELECT a.user_id, a.event_type AS key_a, b.event_type AS key_b, a.n AS n_a, b.n AS n_b, 'PENDING' AS review_status FROM k a JOIN k b ON a.user_id = b.user_id AND a.event_type < b.event_type WHERE a.n = b.n",
)
def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a project's indicators that may be one, by equal numbers of observations; both sides are counted first, and
    pairs meet by project and count."""
    k = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    a, b = k.withColumnRenamed("event_type", "key_a"), k.withColumnRenamed("event_type", "key_b")
    return a.join(b, ["user_id", "n"]).filter("key_a < key_b").select("user_id", "key_a", "key_b", F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit("PENDING").alias("review_status"))


@query(
    "original_closing",
    "WITH l AS (SELECT o_custkey, CASE l_returnflag WHEN 'R' THEN 'RESTRUCTURING_PAPER' WHEN 'A' THEN 'FIRST_REPORT' ELSE 'AGREEMENT' END AS source, CAST(min(l_shipdate) AS DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) SELECT o_custkey, CASE WHEN count(DISTINCT day) = 1 THEN min(day) END AS original_closing_date, CASE WHEN count(DISTINCT day) = 1 THEN 'EXACT' ELSE 'CONFLICT' END AS status, string_agg(source, ',' ORDER BY source) AS sources FROM l GROUP BY 1",
)
def original_closing(spark: SparkSession, d: str) -> DataFrame:
    """The original closing date if all sources that state one agree."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    source = F.when(F.col("l_returnflag") == "R", "RESTRUCTURING_PAPER").when(F.col("l_returnflag") == "A", "FIRST_REPORT").otherwise("AGREEMENT")
    per = rows.groupBy("o_custkey", source.alias("source")).agg(F.min(F.col("l_shipdate").cast("date")).alias("day"))
    one = F.count_distinct("day") == 1
    return per.groupBy("o_custkey").agg(F.when(one, F.min("day")).alias("original_closing_date"), F.when(one, "EXACT").otherwise("CONFLICT").alias("status"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


@query(
    "cross_checked",
    "SELECT o_orderkey, CASE WHEN abs(t - s) <= 0.005 * greatest(abs(t), abs(s)) THEN 'MATCH' WHEN s IS NULL THEN 'NOT_IN_STRUCTURED' ELSE 'MISMATCH' END AS amount_status, CASE WHEN d = first_ship THEN 'MATCH' WHEN first_ship IS NULL THEN 'NOT_IN_STRUCTURED' ELSE 'MISMATCH' END AS date_status FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t, CAST(o_orderdate AS DATE) + 30 AS d FROM orders) LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, min(CAST(l_shipdate AS DATE)) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def cross_checked(spark: SparkSession, d: str) -> DataFrame:
    """A report's amount and date against the structured records."""
    from tallyforge.functions.numbers import within

    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(M)).alias("s"), F.min(F.col("l_shipdate").cast("date")).alias("first_ship"))
    rows = table(spark, d, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    status = lambda ok, other: F.when(ok, "MATCH").when(other.isNull(), "NOT_IN_STRUCTURED").otherwise("MISMATCH")
    return rows.select("o_orderkey", status(within(F.col("o_totalprice").cast(M), F.col("s")), F.col("s")).alias("amount_status"), status(F.date_add(F.col("o_orderdate").cast("date"), 30) == F.col("first_ship"), F.col("first_ship")).alias("date_status"))


@query(
    "project_checks",
    """WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT c_custkey, coalesce(n, 0) AS reports, coalesce(back, 0) AS date_regressions, CASE WHEN n IS NULL THEN 'WITHOUT_REPORTS' WHEN n < 10 THEN 'FEWER_THAN_EXPECTED' ELSE 'AS_EXPECTED' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (day < before) AS back FROM r GROUP BY 1) ON o_custkey = c_custkey""",
)
def project_checks(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag(F.col("o_orderdate").cast("date")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    per = table(spark, d, "orders").withColumn("before", before).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderdate").cast("date") < F.col("before")).alias("back"))
    rows = table(spark, d, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("n").isNull(), "WITHOUT_REPORTS").when(F.col("n") < 10, "FEWER_THAN_EXPECTED").otherwise("AS_EXPECTED")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("reports"), F.coalesce("back", F.lit(0)).alias("date_regressions"), status.alias("status"))
