"""Grammars of parsed reports, as plans over rows of tables and lines of text.

Rows are (document_id, page, table_no, row_no, cells array<string>), lines (document_id, page, line_no, text). What a row
takes from the rows above it (a header, a group, a block) is carried by windows inside its document; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import printed_number

#: The scale of ratings, worst first.
RATINGS = ("Highly Unsatisfactory", "Unsatisfactory", "Moderately Unsatisfactory", "Moderately Satisfactory", "Satisfactory", "Highly Satisfactory")
RATING = "|".join(sorted(RATINGS, key=len, reverse=True))
DATE_OR_NONE = r"[0-9]{2}-[A-Z][a-z]{2}-[0-9]{4}|--"
KEY_DATES = ("approval", "signing", "effectiveness", "original_closing", "current_closing")
ROLES = ("baseline", "previous", "current", "target")


def _upto(keys: list[str], order: list[str], last: int = 0) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def cell(cells: Column, i: Column) -> Column:
    """A cell's trimmed text; blank and missing ones are null."""
    return F.nullif(F.trim(F.get(cells, i)), F.lit(""))


def located(cells: Column, word: str) -> Column:
    """The place of the first cell that holds a word, from 0, or null."""
    at = F.array_position(F.transform(cells, lambda c: F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))), True)
    return F.when(at > 0, (at - 1).cast("int"))


def subject_of(c: Column, subjects: dict[str, str]) -> Column:
    """The first subject whose printed prefix a cell or line begins with."""
    return F.coalesce(*(F.when(F.startswith(F.lower(F.trim(c)), F.lit(p.lower())), s) for p, s in subjects.items()))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", nth).filter("__n = 1").drop("__n")


def rated_rows(rows: DataFrame, subjects: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """(document_id, page, subject, a column for each of ``columns``) of the rows that begin with a subject, below a header
    whose columns are located by the words of ``columns``. A header holds on across page breaks until the next one; of a
    subject's rows the first counts."""
    head = F.struct(*(located(F.col("cells"), word).alias(name) for name, word in columns.items()))
    is_head = ~F.exists(F.array(*(head[n] for n in columns)), lambda i: i.isNull())
    rows = rows.withColumn("__is", is_head).withColumn("__head", F.when(is_head, head))
    rows = rows.withColumn("__head", F.last("__head", ignorenulls=True).over(_upto(["document_id"], ["page", "table_no", "row_no"])))
    rows = rows.withColumn("subject", subject_of(F.get("cells", F.lit(0)), subjects)).filter("not __is and __head is not null and subject is not null")
    rows = first_of(rows, ["document_id", "subject"], ["page", "table_no", "row_no"])
    return rows.select("document_id", "page", "subject", *(cell(F.col("cells"), F.col("__head")[n]).alias(n) for n in columns))


def rated_lines(lines: DataFrame, subjects: dict[str, str]) -> DataFrame:
    """(document_id, page, subject, previous, current) of lines that begin with a subject and hold two ratings, by
    themselves or with the next line, be it on the next page; with another number they say nothing."""
    order = Window.partitionBy("document_id").orderBy("page", "line_no")
    lines = lines.withColumn("__both", F.concat_ws(" ", "text", F.lead("text").over(order))).withColumn("subject", subject_of(F.col("text"), subjects)).filter("subject is not null")
    ratings = lambda c: F.regexp_extract_all(c, F.lit(f"({RATING})"), F.lit(1))
    own, both = ratings(F.col("text")), ratings(F.col("__both"))
    found = lines.withColumn("__r", F.when(F.size(own) == 2, own).when((F.size(own) < 2) & (F.size(both) == 2), both)).filter("__r is not null")
    found = first_of(found, ["document_id", "subject"], ["page", "line_no"])
    return found.select("document_id", "page", "subject", F.get("__r", F.lit(0)).alias("previous"), F.get("__r", F.lit(1)).alias("current"))


def preferred(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``first`` where it has a key, else ``second``; ``method`` names which one it was."""
    a, b = first.select(*keys, F.struct(*values).alias("__a")), second.select(*keys, F.struct(*values).alias("__b"))
    both = a.join(b, keys, "full").withColumn("__v", F.coalesce("__a", "__b"))
    return both.select(*keys, *(F.col("__v")[v].alias(v) for v in values), F.when(F.col("__a").isNotNull(), "TABLE").otherwise("TEXT").alias("method"))


def key_dates(lines: DataFrame) -> DataFrame:
    """The five key dates of a document's first line that holds exactly five dates or dashes; a stray date is no such line."""
    tokens = F.regexp_extract_all("text", F.lit(f"({DATE_OR_NONE})"), F.lit(1))
    found = first_of(lines.withColumn("__t", tokens).filter(F.size("__t") == 5), ["document_id"], ["page", "line_no"])
    return found.select("document_id", *(F.to_date(F.try_to_timestamp(F.get("__t", F.lit(i)), F.lit("dd-MMM-yyyy"))).alias(n) for i, n in enumerate(KEY_DATES)))


def narratives(lines: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(document_id, title, text): the lines below each title down to the next, titles by expression; of a document's equal
    titles the first counts."""
    title = F.coalesce(*(F.when(F.col("text").rlike(x), t) for t, x in titles.items()))
    rows = lines.withColumn("__own", title)
    upto = _upto(["document_id"], ["page", "line_no"])
    rows = rows.withColumn("title", F.last("__own", ignorenulls=True).over(upto)).withColumn("__nth", F.sum(F.col("__own").isNotNull().cast("int")).over(upto))
    texts = rows.filter("__own is null and title is not null").groupBy("document_id", "title", "__nth")
    texts = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    return first_of(texts, ["document_id", "title"], ["__nth"]).drop("__nth")


def roles_of_header(top: Column, sub: Column) -> Column:
    """A role for each column of two header rows: the upper cell, carried to the right over merged ones, names baseline,
    previous, current or target, the lower one value or date; other columns are null."""
    carried = F.transform(top, lambda c, i: F.element_at(F.filter(F.slice(top, F.lit(1), i + 1), lambda x: F.trim(x) != ""), -1))
    name = lambda c: F.coalesce(*(F.when(F.contains(F.lower(c), F.lit(r)), r) for r in ROLES))
    part = lambda c: F.when(F.contains(F.lower(c), F.lit("date")), "date").when(F.contains(F.lower(c), F.lit("value")), "value")
    return F.zip_with(carried, sub, lambda a, b: F.when(name(a).isNotNull() & part(b).isNotNull(), F.concat(name(a), F.lit("_"), part(b))))


def table_kind(cells: Column) -> Column:
    """DLI, WIDE or BLOCK by a table's header; tables of loans and any others are null."""
    text = F.lower(F.concat_ws(" ", cells))
    has = lambda w: F.contains(text, F.lit(w))
    return F.when(has("loan"), None).when(has("disbursement linked") | text.rlike(r"\bdlis?\b"), "DLI").when(has("baseline") & has("target"), "WIDE").when(has("indicator name"), "BLOCK")


def resplit(cells: Column, width: int) -> Column:
    """``width`` values of a row: its cells; or, where all but one are blank, the tokens of that one if they are as many."""
    full = F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    tokens = F.split(F.trim(F.get(full, F.lit(0))), r"\s+")
    return F.when((F.size(full) == 1) & (F.size(tokens) == width), tokens).when(F.size(cells) == width, F.transform(cells, lambda c: F.nullif(F.trim(c), F.lit(""))))


def wide_rows(rows: DataFrame, width: int) -> DataFrame:
    """(document_id, page, row_no, grp, name, values, comments) of a wide table: a row of which only the first cell is
    filled opens a group, which holds on across page breaks; one that begins with 'Comments' belongs to the row above."""
    first, rest = cell(F.col("cells"), F.lit(0)), F.filter(F.slice("cells", F.lit(2), F.lit(width)), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    rows = rows.withColumn("__c", F.when(F.lower(first).startswith("comments"), F.trim(F.regexp_replace(first, r"(?i)^comments:?\s*", ""))))
    rows = rows.withColumn("__g", F.when((F.size(rest) == 0) & F.col("__c").isNull(), first))
    data = F.col("__c").isNull() & F.col("__g").isNull() & first.isNotNull()
    upto = _upto(["document_id"], ["page", "row_no"])
    rows = rows.withColumn("__data", data).withColumn("grp", F.last("__g", ignorenulls=True).over(upto)).withColumn("__nth", F.sum(data.cast("int")).over(upto))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__c").isNotNull(), F.struct("page", "row_no", "__c")))), lambda x: x["__c"]), " ")
    one = F.max(F.when(F.col("__data"), F.struct("page", "row_no", "grp", first.alias("name"), resplit(F.slice("cells", F.lit(2), F.lit(width)), width).alias("values"))))
    return rows.filter("__nth > 0").groupBy("document_id", "__nth").agg(one.alias("r"), F.nullif(said, F.lit("")).alias("comments")).select("document_id", "r.*", "comments")


def blocks(lines: DataFrame, is_name: Column, width: int = 4) -> DataFrame:
    """(document_id, page, name, values, dates, problems) of blocks: a name, then a Value and a Date line of exactly
    ``width`` tokens each. A block with another number of tokens, or without its value line, says what is wrong."""
    upto = _upto(["document_id"], ["page", "line_no"])
    rows = lines.withColumn("__name", is_name).withColumn("__nth", F.sum(is_name.cast("int")).over(upto)).filter("__nth > 0")
    tokens = F.filter(F.split(F.regexp_replace("text", r"^(Value|Date)\s+", ""), r"\s+"), lambda t: t != "")
    of = lambda w: F.min(F.when(F.col("text").rlike(rf"^{w}\b") & ~F.col("__name"), F.struct("page", "line_no", tokens.alias("t"))))["t"]
    per = rows.groupBy("document_id", "__nth").agg(F.min("page").alias("page"), F.min(F.when(F.col("__name"), F.struct("line_no", "text")))["text"].alias("name"), of("Value").alias("v"), of("Date").alias("d"))
    fits = lambda c: F.when(F.size(c) == width, F.col(c))
    problems = F.array_compact(F.array(F.when(F.col("v").isNull(), "no values").when(F.size("v") != width, "value count"), F.when(F.size("d") != width, "date count")))
    return per.select("document_id", "page", "name", fits("v").alias("values"), fits("d").alias("dates"), problems.alias("problems"))


def chosen(table: DataFrame, text: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A value for each key from two readings: the one there is, or both if they agree; disagreement is null and CONFLICT."""
    both = table.select(*keys, F.col(value).alias("__t")).join(text.select(*keys, F.col(value).alias("__x")), keys, "full")
    t, x = F.col("__t"), F.col("__x")
    status = F.when(t.isNull(), "TEXT").when(x.isNull(), "TABLE").when(t == x, "AGREED").otherwise("CONFLICT")
    return both.select(*keys, F.when(t.isNull() | x.isNull() | (t == x), F.coalesce(t, x)).alias(value), status.alias("status"))


def completed(lines: DataFrame, starts: Column, most: int = 4) -> DataFrame:
    """(document_id, page, line_no, name): lines that open a name, with up to ``most`` further lines until its parentheses
    close; a name that does not close stays as its own line."""
    order = Window.partitionBy("document_id").orderBy("page", "line_no")
    nexts = [F.lead("text", i).over(order) for i in range(1, most + 1)]
    tries = F.array(*(F.concat_ws(" ", "text", *nexts[:i]) for i in range(most + 1)))
    opened = lambda c: F.regexp_count(c, F.lit(r"\(")) == F.regexp_count(c, F.lit(r"\)"))
    rows = lines.withColumn("__start", starts).withColumn("__tries", tries).filter("__start")
    closed = F.get(F.filter("__tries", opened), F.lit(0))
    return rows.select("document_id", "page", "line_no", F.coalesce(closed, F.col("text")).alias("name"))


def withheld(rows: DataFrame, problems: str, values: list[str]) -> DataFrame:
    """Observations with a status: with a problem they are AMBIGUOUS and their values are withheld."""
    bad = F.size(problems) > 0
    others = [c for c in rows.columns if c not in values]
    return rows.select(*others, *(F.when(~bad, F.col(v)).alias(v) for v in values), F.when(bad, "AMBIGUOUS").otherwise("OK").alias("status"))


def agreed_rating(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key: its value if all its rows agree, else null and CONFLICT."""
    per = rows.groupBy(*keys).agg(F.count_distinct(value).alias("__n"), F.min(value).alias("__v"))
    return per.select(*keys, F.when(F.col("__n") == 1, F.col("__v")).alias(value), F.when(F.col("__n") == 1, "OK").when(F.col("__n") == 0, "MISSING").otherwise("CONFLICT").alias("status"))


def continued(rows: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(document_id, page, row_no, a column for each of ``roles``) of tables with headed columns: a table without a header
    goes on with the last one only on the same or the next page and with as many columns. A row without its first role is
    a fragment and is appended to the row above."""
    head = F.struct(*(F.coalesce(*(F.when(F.get("cells", F.lit(i)).rlike(x), i) for i in range(8))).alias(r) for r, x in roles.items()))
    first = next(iter(roles))
    is_head = head[first].isNotNull() & head[[*roles][-1]].isNotNull()
    rows = rows.withColumn("__is", F.coalesce(is_head, F.lit(False)))
    rows = rows.withColumn("__h", F.when(F.col("__is"), F.struct("page", F.size("cells").alias("width"), head.alias("at"))))
    upto = _upto(["document_id"], ["page", "table_no", "row_no"])
    seen = F.last("page").over(_upto(["document_id"], ["page", "table_no", "row_no"], -1))
    rows = rows.withColumn("__h", F.last("__h", ignorenulls=True).over(upto)).withColumn("__gap", F.col("page") - F.coalesce(seen, F.col("page")))
    rows = rows.withColumn("__far", F.max("__gap").over(Window.partitionBy("document_id", "__h.page").orderBy("page", "table_no", "row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.filter("not __is and __h is not null and size(cells) = __h.width and __far <= 1")
    values = {r: cell(F.col("cells"), F.col("__h")["at"][r]) for r in roles}
    rows = rows.withColumn("__new", values[first].isNotNull().cast("int"))
    rows = rows.withColumn("__nth", F.sum("__new").over(upto)).filter("__nth > 0")
    joined = lambda r: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(values[r].isNotNull(), F.struct("page", "table_no", "row_no", values[r].alias("v"))))), lambda x: x["v"]), " "), F.lit(""))
    return rows.groupBy("document_id", "__nth").agg(F.min(F.struct("page", "row_no")).alias("at"), *(joined(r).alias(r) for r in roles)).select("document_id", "at.page", "at.row_no", *roles)


def titled_risk(title: Column) -> Column:
    """(category, rating) of a section's title such as 'Fiduciary Risk (Substantial)'."""
    return F.struct(
        F.nullif(F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*\([^()]*\)\s*$", ""), r"(?i)\s*risks?\s*$", "")), F.lit("")).alias("category"),
        F.nullif(F.regexp_extract(title, r"(?i)\((high|substantial|moderate|low)\)\s*$", 1), F.lit("")).alias("rating"),
    )


def change_flags(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """(document_id, flag, changed): rows of a label and its Yes/No, or of two tick columns, the first for yes; neither or
    both ticked is null. Of a flag's rows the first that says anything counts."""
    label = subject_of(F.get("cells", F.lit(0)), names)
    second, third = cell(F.col("cells"), F.lit(1)), cell(F.col("cells"), F.lit(2))
    ticks = F.when(second.isNotNull() & third.isNull(), True).when(second.isNull() & third.isNotNull(), False)
    changed = F.when(F.lower(second) == "yes", True).when(F.lower(second) == "no", False).otherwise(ticks)
    found = rows.select("document_id", "page", "row_no", label.alias("flag"), changed.alias("changed")).filter("flag is not null and changed is not null")
    return first_of(found, ["document_id", "flag"], ["page", "row_no"]).select("document_id", "flag", "changed")


def flagged_events(flags: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id, type, status): an event for each flag that says yes and each type found in tables. CONFIRMED by both,
    FLAG_ONLY, TABLE_ONLY without any flag, CONFLICT where the flag says no."""
    f, t = flags.select("document_id", F.col("flag").alias("type"), "changed"), found.select("document_id", "type").distinct().withColumn("__t", F.lit(True))
    rows = f.join(t, ["document_id", "type"], "full").filter("changed or __t")
    status = F.when(F.col("changed") & F.col("__t").isNotNull(), "CONFIRMED").when(F.col("changed"), "FLAG_ONLY").when(F.col("changed").isNull(), "TABLE_ONLY").otherwise("CONFLICT")
    return rows.select("document_id", "type", status.alias("status"))


def rendered(rows: DataFrame) -> DataFrame:
    """(document_id, page, table_no, text): a table's rows below its first one as 'Header: value' pairs, blank cells left
    out, one line each."""
    head = F.first("cells").over(Window.partitionBy("document_id", "page", "table_no").orderBy("row_no"))
    nth = F.row_number().over(Window.partitionBy("document_id", "page", "table_no").orderBy("row_no"))
    pairs = F.array_compact(F.zip_with("__head", "cells", lambda h, c: F.when(F.trim(c) != "", F.concat(h, F.lit(": "), F.trim(c)))))
    lines = rows.withColumn("__head", head).withColumn("__nth", nth).filter("__nth > 1").withColumn("__line", F.array_join(pairs, "; "))
    return lines.groupBy("document_id", "page", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "__line"))), lambda x: x["__line"]), "\n").alias("text"))


def coverage(pages: DataFrame, kept: str, whole: str) -> Column:
    """Share of the distinct tokens of a page's text layer that its parsed text has; 1 where the layer has none."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(tokens(F.col(kept)), tokens(F.col(whole)))).cast("double"), F.size(tokens(F.col(whole))).cast("double")), 4), F.lit(1.0))


def additional_financing(rows: DataFrame) -> DataFrame:
    """(document_id, page, table_no, row_no, amount, event_date, project, financing_type): an event for each row of the
    lender in a table that proposes additional financing, dated by the first printed approval date of the paper; the
    project and the type are those of its last table of types. A date or a number that can't be read is null."""
    table_ = Window.partitionBy("document_id", "page", "table_no").orderBy("row_no")
    paper = Window.partitionBy("document_id")
    first = F.first("cells").over(table_.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__head", first).withColumn("__nth", F.row_number().over(table_))
    approved = F.filter(F.transform("cells", lambda c: F.regexp_extract(F.trim(c), r"^Approval Date\s+([0-9]{2}-[A-Z][a-z]{2}-[0-9]{4})$", 1)), lambda c: c != "")
    date = F.when(F.size(approved) > 0, F.struct("page", "table_no", "row_no", F.get(approved, F.lit(0)).alias("day")))
    at, kind = located(F.col("__head"), "project id"), located(F.col("__head"), "additional financing type")
    typed = F.when((F.col("__nth") == 2) & kind.isNotNull(), F.struct("page", "table_no", cell(F.col("cells"), at).alias("project"), cell(F.col("cells"), kind).alias("financing_type")))
    rows = rows.withColumn("__date", F.min(date).over(paper)["day"]).withColumn("__typed", F.max(typed).over(paper))
    col = located(F.col("__head"), "proposed additional financing")
    lent = F.lower(cell(F.col("cells"), F.lit(0))).startswith("of which ibrd")
    amounts = rows.filter((F.col("__nth") > 1) & col.isNotNull() & lent)
    day = F.to_date(F.try_to_timestamp("__date", F.lit("dd-MMM-yyyy")))
    return amounts.select("document_id", "page", "table_no", "row_no", printed_number(cell(F.col("cells"), col)).alias("amount"), day.alias("event_date"), F.col("__typed.project").alias("project"), F.col("__typed.financing_type").alias("financing_type"))
