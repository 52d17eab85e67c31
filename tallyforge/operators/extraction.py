"""Facts out of lines of text: furniture, labelled values, citations, carried context, and the choice among readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import collapse, line_signature

STATUS = ("EXACT", "NORMALIZED", "AMBIGUOUS", "MISSING")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, line), from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))


def carried(rows: DataFrame, keys: list[str], order: str, opens: Column, name: str) -> DataFrame:
    """Each row with the last opening value before or at it: sections over headings, tables over page breaks."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(opens, ignorenulls=True).over(w))


def furniture(rows: DataFrame, keys: list[str], page: str, line: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """(keys, signature): masked lines on at least ``least`` pages and that share of a document's pages."""
    pages = rows.groupBy(*keys).agg(F.count_distinct(page).alias("__pages"))
    per = rows.groupBy(*keys, line_signature(F.col(line)).alias("signature")).agg(F.count_distinct(page).alias("__on"))
    return per.join(pages, keys).filter((F.col("__on") >= least) & (F.col("__on") >= share * F.col("__pages"))).select(*keys, "signature")


def labelled(text: Column, label: str, value: str) -> Column:
    """The first value that stands behind a label and a colon or an equals sign; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?im)\b{label}\s*[:=]\s*[\"']?({value})", 1), F.lit(""))


def in_vocabulary(raw: Column, words: dict[str, str]) -> Column:
    """(value, status): a raw word by a vocabulary whose keys are lower case."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    found = F.try_element_at(table, F.lower(collapse(raw)))
    status = F.when(collapse(raw).isNull(), "MISSING").when(found.isNull(), "AMBIGUOUS").when(found == raw, "EXACT").otherwise("NORMALIZED")
    return F.struct(found.alias("value"), status.alias("status"))


def one_reading(first: Column, second: Column) -> Column:
    """(value, status) of two readings of one cell: the only one, the agreed one, or a conflict and no value."""
    value = F.when(first.isNull() | second.isNull() | (first == second), F.coalesce(first, second))
    status = F.when(first.isNull() & second.isNull(), "MISSING").when(value.isNull(), "CONFLICT").otherwise("EXACT")
    return F.struct(value.alias("value"), status.alias("status"))


def exact_tokens(line: Column, pattern: str, count: int) -> Column:
    """The tokens of a line that fit a pattern if there are exactly so many, else null: a row that lacks a cell is not read."""
    found = F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1))
    return F.when(F.size(found) == count, found)


def cited_dates(text: Column) -> Column:
    """Distinct ISO dates that a text cites, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda d: F.to_date(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")))), lambda d: d.isNotNull())))


def blocks(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """Rows with the number of the block they stand in: a running count of block starts, 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("block", F.sum(starts.cast("long")).over(w))
