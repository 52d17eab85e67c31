"""Checks whose findings are rows: a code of the catalogue, its severity, and what it was found in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The catalogue of codes with their severities.
CODES = {
    "REQUIRED_BLANK": "ERROR", "UNPARSABLE_DATE": "ERROR", "UNPARSABLE_AMOUNT": "ERROR", "NEGATIVE_AMOUNT": "ERROR", "DATE_ORDER": "ERROR", "DUPLICATE_ID": "ERROR", "BROKEN_REFERENCE": "ERROR",
    "REGISTRY_MISMATCH": "WARNING", "SEVERAL_LOANS": "INFO", "UNRECOGNISED_NOTATION": "WARNING", "SEVERAL_SNAPSHOT_DATES": "WARNING", "CONTRACT_ON_SEVERAL_ROWS": "INFO", "ROWS_FOR_UNCOVERED_ENTITY": "WARNING",
    "COMMITMENT_DIFFERS": "WARNING", "COMMITMENT_NOT_COMPARABLE": "INFO", "AMOUNT_COLUMNS_DIFFER": "INFO", "OPTIONAL_BLANK": "INFO", "IDENTICAL_CONTENT": "WARNING", "UNCLASSIFIED": "INFO", "SIZE_CHANGED": "WARNING",
    "SEQUENCE_GAP": "WARNING", "COMPONENT_DIFFERENCE": "WARNING", "NO_COVERAGE": "INFO", "METADATA_GAP": "INFO",
    "PDF_PAGE_COUNT_MISMATCH": "ERROR", "NO_USABLE_TEXT": "ERROR", "EMPTY_PAGES": "INFO", "LOW_TEXT_EXTRACTION": "WARNING", "LOW_TEXT_COVERAGE": "WARNING", "PAGE_PROVENANCE_INVALID": "ERROR", "DOCUMENT_PROJECT_MISMATCH": "ERROR",
    "METADATA_CORRECTED_FROM_DOCUMENT": "WARNING", "METADATA_CONFLICT": "WARNING", "DOCUMENT_TYPE_UNRESOLVED": "ERROR", "MISSING_EXPECTED_METADATA": "ERROR", "ISR_DATES_DIFFER": "INFO", "TABLE_CELLS_DROPPED": "WARNING", "PARSER_WARNING": "INFO",
    "DOCUMENT_LOAN_REFERENCE_LINKED": "INFO", "DOCUMENT_LOAN_REFERENCE_UNLINKED": "WARNING",
}


#: Types of documents that must have text, and the bounds of their text.
KEY_TYPES = ("ISR", "APPRAISAL_DOCUMENT", "RESTRUCTURING_PAPER", "ADDITIONAL_FINANCING")
LEAST_TEXT, LEAST_PER_PAGE, LEAST_COVERAGE, MOST_EMPTY = 1000, 400, 0.95, 0.25


class UnknownCode(ValueError):
    """A check that the catalogue doesn't know."""


def found(rows: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
    """(key, code, severity) for each check that holds in a row; one pass over the rows for all checks. A condition that is
    null is no finding; a code must be in the catalogue."""
    if unknown := sorted(set(checks) - set(CODES)):
        raise UnknownCode(", ".join(unknown))
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("code"), F.lit(CODES[k]).alias("severity"))) for k, c in checks.items())))
    return rows.select(key.cast("string").alias("key"), F.explode(hits).alias("x")).select("key", "x.code", "x.severity")


def commitment(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """COMMITMENT_DIFFERS where two sources' amounts are apart, COMMITMENT_NOT_COMPARABLE where one is unknown, else null."""
    return F.when(a.isNull() | b.isNull(), "COMMITMENT_NOT_COMPARABLE").when(F.abs(a - b) > tolerance, "COMMITMENT_DIFFERS")


def metadata_gaps(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n, first_key): how many rows lack each optional column, columns without a gap left out; one aggregation."""
    blank = {c: (F.trim(c) == "") if isinstance(df.schema[c].dataType, T.StringType) else F.lit(False) for c in columns}
    missing = {c: F.col(c).isNull() | blank[c] for c in columns}
    one = df.agg(*(F.count_if(m).alias(f"n_{c}") for c, m in missing.items()), *(F.min(F.when(m, F.col(key))).alias(f"k_{c}") for c, m in missing.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"k_{c}").alias("first_key")) for c in columns)))).filter("n > 0")


def ordered_dates(*dates: Column) -> Column:
    """True if the dates that are known stand in order."""
    known = F.array_compact(F.array(*dates))
    return F.array_sort(known) == known


def theme_nodes(rows: DataFrame, path: list[str], share: str, ref: str) -> DataFrame:
    """A row for each distinct node of a hierarchy, with its references sorted, its share if all rows agree on it, and
    whether they conflict."""
    agg = rows.groupBy(*path).agg(F.array_sort(F.collect_set(ref)).alias("refs"), F.count_distinct(share).alias("__n"), F.min(share).alias("__v"))
    return agg.select(*path, "refs", F.when(F.col("__n") == 1, F.col("__v")).alias(share), (F.col("__n") > 1).alias("conflict"))


def document_checks(docs: DataFrame, key: str) -> DataFrame:
    """(key, code, severity, detail) for each finding in parsed documents: all checks of a row in one pass.

    ``docs`` has pages, pdf_pages, empty_pages, clean_chars, document_type, coverage, invalid_elements, filed_elsewhere,
    corrected and conflicting (arrays of field names), isr_sequence, archive_date, report_number, report_date,
    document_date, dropped_cells and other_warnings. A document without pages has no further findings; what is unknown
    (null) is found only where it is expected.
    """
    c = F.col
    of = lambda when, code, detail=None, severity=None: F.when(when, F.struct(F.lit(code).alias("code"), (severity if severity is not None else F.lit(CODES[code])).alias("severity"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail")))
    report, kind = F.coalesce(c("document_type") == "ISR", F.lit(False)), F.coalesce(c("document_type"), F.lit("OTHER"))
    scarce = kind.isin(*KEY_TYPES) & (c("clean_chars") < LEAST_TEXT)
    empty = F.when(c("empty_pages") > MOST_EMPTY * c("pages"), "WARNING").otherwise("INFO")
    missing = lambda name: of(report & c(name).isNull(), "MISSING_EXPECTED_METADATA", F.lit(name))
    fields = lambda names, code: F.transform(F.coalesce(c(names), F.array().cast("array<string>")), lambda f: of(F.lit(True), code, f))
    pages = of(c("pages") != c("pdf_pages"), "PDF_PAGE_COUNT_MISMATCH")
    none = c("pages").isNull() | (c("pages") <= 0)
    found = F.array(
        pages,
        of(c("empty_pages") > 0, "EMPTY_PAGES", c("empty_pages"), empty),
        of(scarce, "NO_USABLE_TEXT", c("clean_chars")),
        of(~scarce & (c("clean_chars") < LEAST_PER_PAGE * c("pages")), "LOW_TEXT_EXTRACTION"),
        of(c("coverage") < LEAST_COVERAGE, "LOW_TEXT_COVERAGE"),
        of(c("invalid_elements") > 0, "PAGE_PROVENANCE_INVALID", c("invalid_elements")),
        of(c("filed_elsewhere"), "DOCUMENT_PROJECT_MISMATCH"),
        of(kind == "OTHER", "DOCUMENT_TYPE_UNRESOLVED"),
        *(missing(name) for name in ("isr_sequence", "archive_date", "report_number")),
        of(report & c("report_date").isNull(), "MISSING_EXPECTED_METADATA", F.lit("report_date"), F.lit("WARNING")),
        of(report & (c("report_date") != c("archive_date")), "ISR_DATES_DIFFER"),
        of(~report & c("document_date").isNull(), "MISSING_EXPECTED_METADATA", F.lit("document_date"), F.lit("INFO")),
        of(c("dropped_cells") > 0, "TABLE_CELLS_DROPPED", c("dropped_cells")),
        of(c("other_warnings") > 0, "PARSER_WARNING", c("other_warnings")),
    )
    found = F.concat(found, fields("corrected", "METADATA_CORRECTED_FROM_DOCUMENT"), fields("conflicting", "METADATA_CONFLICT"))
    hits = F.array_compact(F.when(none, F.array(pages, of(F.lit(True), "NO_USABLE_TEXT", F.lit("no pages")))).otherwise(found))
    return docs.select(key, F.explode(hits).alias("x")).select(key, "x.*")
