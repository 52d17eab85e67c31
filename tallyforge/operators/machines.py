"""State machines over the lines of documents, run as parallel prefixes: a document of any length is read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.prefix import machine, scan

ORPHAN, NAME, VALUE, DATE = range(4)
#: What a line is, and the next state for each state above.
OTHER_LINE, NAME_LINE, VALUE_LINE, DATE_LINE, RESET_LINE = range(5)
BLOCKS = [
    [ORPHAN, NAME, VALUE, DATE],  # other lines go on with a name, or comment on what is complete
    [NAME, NAME, NAME, NAME],
    [ORPHAN, VALUE, VALUE, ORPHAN],
    [ORPHAN, ORPHAN, DATE, ORPHAN],
    [ORPHAN, ORPHAN, ORPHAN, ORPHAN],
]


def line_kind(text: Column, name: str, reset: str) -> Column:
    """What a line is to a block: patterns say which lines begin a name and which end any block."""
    return (
        F.when(text.rlike(name), NAME_LINE).when(text.rlike(reset), RESET_LINE).when(text.rlike(r"(?i)^value\b"), VALUE_LINE).when(text.rlike(r"(?i)^date\b"), DATE_LINE).otherwise(OTHER_LINE)
    )


def block_readings(lines: DataFrame, name: str, reset: str, width: int = 4) -> DataFrame:
    """(document_id, place, page, name, values, dates, comments, problems) of the blocks of lines (document_id, place, page,
    text); ``place`` is where a block's name begins.

    A block is a name of one or more lines, a Value and a Date line of ``width`` tokens, and comments up to the next name
    or reset. Value and Date lines that follow no name are orphans and belong to no block. What is missing, doubled or of
    another width is a problem, and such values or dates are null. Null lines are lines of no kind.
    """
    text = F.coalesce("text", F.lit(""))
    kind, before, after = F.col("__kind"), F.col("__state.before"), F.col("__state.after")
    begun = {"__begun": F.when(kind == NAME_LINE, F.col("place"))}
    rows = machine(lines.withColumn("__kind", line_kind(text, name, reset)), ["document_id"], "place", kind, BLOCKS, "__state", carry=begun)
    rows = rows.filter((before != ORPHAN) | (after != ORPHAN)).filter(kind != RESET_LINE)
    tokens = F.filter(F.split(F.trim(F.regexp_replace(text, r"(?i)^(value|date)\b\s*", "")), r"\s+"), lambda t: t != "")
    of = lambda is_one: F.array_sort(F.collect_list(F.when(is_one, F.struct("place", "page", F.trim(text).alias("text"), tokens.alias("t")))))
    per = rows.groupBy("document_id", "__begun").agg(
        of((after == NAME) & (text != "")).alias("n"),
        of((kind == VALUE_LINE) & (after == VALUE)).alias("v"),
        of((kind == DATE_LINE) & (after == DATE)).alias("d"),
        of((kind == OTHER_LINE) & (after == DATE) & (text != "")).alias("c"),
        F.max(F.when(kind == DATE_LINE, after == ORPHAN)).alias("early"),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), " ")
    fits = lambda c: F.when((F.size(c) == 1) & (F.size(F.get(c, F.lit(0))["t"]) == width), F.get(c, F.lit(0))["t"])
    problem = lambda c, what: F.when(F.size(c) == 0, f"no {what}").when(F.size(c) > 1, f"{what} twice").when(fits(F.col(c)).isNull(), f"{what} count")
    problems = F.array_compact(F.array(problem("v", "values"), problem("d", "dates"), F.when(F.col("early"), "date out of place")))
    return per.select(
        "document_id", F.col("__begun").alias("place"), F.get("n", F.lit(0))["page"].alias("page"), joined("n").alias("name"),
        fits(F.col("v")).alias("values"), fits(F.col("d")).alias("dates"), F.nullif(joined("c"), F.lit("")).alias("comments"), problems.alias("problems"),
    )


def in_sections(elements: DataFrame, is_heading: Column, furniture: Column, front: str = "FRONT_MATTER") -> DataFrame:
    """``elements`` (document_id, place, text) with (section_no, section, is_heading): a heading opens a section that goes on
    to the next one; what stands before the first is ``front``, number 0. Furniture (running headers, footers) has none,
    and a heading that is furniture or blank opens none."""
    opens = F.coalesce(is_heading & ~furniture & (F.trim("text") != ""), F.lit(False))
    rows = elements.withColumn("is_heading", opens).withColumn("__furniture", F.coalesce(furniture, F.lit(False)))
    unit = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("title"))
    value = F.struct(F.col("is_heading").cast("long").alias("n"), F.when(F.col("is_heading"), F.trim("text")).alias("title"))
    rows = scan(rows, ["document_id"], "place", value, unit, lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.coalesce(b["title"], a["title"]).alias("title")), "__section")
    own = lambda c: F.when(~F.col("__furniture"), c)
    rows = rows.withColumn("section_no", own(F.col("__section.after.n"))).withColumn("section", own(F.coalesce("__section.after.title", F.lit(front))))
    return rows.drop("__section", "__furniture")


def numbered_blocks(lines: DataFrame, starts: Column, parts: dict[str, str]) -> DataFrame:
    """(document_id, place, a column for each of ``parts``): blocks of lines that begin where ``starts`` holds, cut into parts
    by the patterns that begin them; the first part begins with the block. A part that comes again goes on with itself."""
    names = list(parts)
    of_line = F.coalesce(*(F.when(F.col("text").rlike(pattern), i) for i, pattern in enumerate(parts.values())))
    begins = F.coalesce(starts, F.lit(False))
    value = F.struct(F.when(begins, F.col("place")).alias("begun"), F.when(begins, F.coalesce(of_line, F.lit(0))).otherwise(of_line).alias("part"))
    unit = F.struct(F.lit(None).cast("long").alias("begun"), F.lit(None).cast("int").alias("part"))
    join = lambda a, b: F.struct(F.coalesce(b["begun"], a["begun"]).alias("begun"), F.coalesce(b["part"], a["part"]).alias("part"))
    rows = scan(lines, ["document_id"], "place", value, unit, join, "__at").filter("__at.after.begun is not null")
    said = lambda i: F.nullif(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("__at.after.part") == i) & F.col("text").isNotNull(), F.struct("place", F.trim(F.regexp_replace("text", parts[names[i]], "")).alias("t"))))), lambda x: x["t"]), " ")), F.lit(""))
    return rows.groupBy("document_id", F.col("__at.after.begun").alias("place")).agg(*(said(i).alias(n) for i, n in enumerate(names)))
