"""What the tools answer: registers filtered, in the order that they are read in, and whether anything was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the least on, and the order of risk records.
SEVERITIES = ("INFO", "WATCH", "HIGH")
RECORD_TYPES = ("FORMAL_RISK_RATING", "ASSESSMENT_FINDING", "ISR_SORT_RATING")


class IntegrityError(ValueError):
    """An argument or a row that the tool's register can't have."""


def _placed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with their place among those of their key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def attention(signals: DataFrame, key: str, status: str = "CURRENT", least: str = "INFO", categories: tuple[str, ...] = ()) -> DataFrame:
    """Signals of a status and of at least a severity: the gravest first, then by category, the latest first, undated last."""
    if least not in SEVERITIES or status not in ("CURRENT", "HISTORICAL", "ALL"):
        raise IntegrityError(f"no severity {least} or status {status}")
    rows = signals.filter(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(least) :]))
    if status != "ALL":
        rows = rows.filter(F.col("signal_status") == status)
    if categories:
        rows = rows.filter(F.col("signal_category").isin(*categories))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return _placed(rows, key, [rank.desc(), F.col("signal_category"), F.col("observed_date").desc_nulls_last(), F.col("signal_id")])


def risks(register: DataFrame, key: str, record_type: str | None = None, category: str | None = None) -> DataFrame:
    """Risk records of a type and a category (case aside): by type, the highest rating first, unrated last, then by day."""
    rows = register
    if record_type:
        rows = rows.filter(F.col("record_type") == record_type)
    if category:
        rows = rows.filter(F.lower("category") == category.strip().lower())
    at = F.array_position(F.array(*map(F.lit, RECORD_TYPES)), F.col("record_type"))
    order = [F.when(at == 0, 99).otherwise(at), F.col("rating_rank").desc_nulls_last(), F.col("observed_date").asc_nulls_last(), F.col("risk_or_finding_id")]
    return _placed(rows, key, order)


def answered(entities: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, status, items) for each entity: an answer without rows is EMPTY, it is not left out."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("items"))
    n = F.coalesce("items", F.lit(0).cast("long"))
    return entities.select(key).distinct().join(per, key, "left").select(key, F.when(n > 0, "OK").otherwise("EMPTY").alias("status"), n.alias("items"))


def loan_links(references: DataFrame, loans: DataFrame, key: str, project: str, raw: str) -> DataFrame:
    """(key, code, severity, status, matched): each document's stated loan against its project's loans, both in the
    notation's base number: linked if exactly one has it. Documents that state none are left out."""
    from tallyforge.functions.records import loan_number

    base = lambda c: loan_number(F.col(c))["base"]
    stated = references.filter(F.trim(raw) != "").select(key, project, F.col(raw).alias("__raw"), base(raw).alias("__base"))
    per = loans.select(project, F.col("loan_number").alias("__loan"), base("loan_number").alias("__base")).groupBy(project, "__base").agg(F.count_distinct("__loan").alias("__n"), F.min("__loan").alias("__one"))
    n, known = F.col("__n"), F.col("__base").isNotNull()
    status = F.when(~known, "UNRECOGNISED").when(n.isNull(), "NO_MATCH").when(n > 1, "AMBIGUOUS").otherwise("LINKED")
    rows = stated.join(per, [project, "__base"], "left").withColumn("status", status)
    linked = F.col("status") == "LINKED"
    code = F.when(linked, "DOCUMENT_LOAN_REFERENCE_LINKED").otherwise("DOCUMENT_LOAN_REFERENCE_UNLINKED")
    return rows.select(key, code.alias("code"), F.when(linked, "INFO").otherwise("WARNING").alias("severity"), "status", F.when(linked, F.col("__one")).alias("matched"))
