"""Identifiers, names, notations and payloads of records, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Printed ligatures and what they stand for, and characters that print nothing.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
INVISIBLE = "​‌‍⁠﻿­"


@F.pandas_udf(T.StringType())
def _composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) and not t.isascii() else t)


def clean_unicode(c: Column) -> Column:
    """Composed (NFC) text with ligatures spelt out and invisible characters gone."""
    out = F.translate(_composed(c), INVISIBLE, "")
    for mark, letters in LIGATURES:
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return out


def fiscal_prefix(c: Column) -> Column:
    """(fiscal_year, rest) of a taxonomy name that begins with FYnn; another name is all rest."""
    year = F.regexp_extract(c, r"^FY(\d{2})\b", 1)
    return F.struct(F.when(year != "", F.concat(F.lit("FY"), year)).alias("fiscal_year"), F.trim(F.regexp_replace(c, r"^FY\d{2}\s*-?\s*", "")).alias("rest"))


def templated(template: str, **parts: Column) -> Column:
    """``template`` with its {names} filled in; a null part reads 'not stated', so no sentence is lost to it."""
    import string

    pieces: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name:
            pieces.append(F.coalesce(parts[name].cast("string"), F.lit("not stated")))
    return F.concat(*pieces)


def short_title(c: Column, most: int = 120) -> Column:
    return F.substring(c, 1, most)


#: The two notations of loan numbers.
STATEMENT_NUMBER, LEGAL_NUMBER = r"^(IBRD)([0-9]{4})([0-9])$", r"^(?:(IBRD)[\s-]*)?([0-9]{4})\s*-\s*([A-Z]{2})$"


def loan_number(c: Column) -> Column:
    """(notation, lender, base, tail, normalized) of a loan number: STATEMENT as IBRD86010, LEGAL as 8601-IN with or
    without its lender. Case and white space aside nothing is corrected: any other text has nulls."""
    text = F.upper(F.trim(c))
    packed = F.regexp_replace(text, r"\s+", "")
    part = lambda of, pattern, n: F.nullif(F.regexp_extract(of, pattern, n), F.lit(""))
    statement, legal = STATEMENT_NUMBER, LEGAL_NUMBER
    is_s, is_l = packed.rlike(statement), text.rlike(legal)
    of = lambda n: F.when(is_s, part(packed, statement, n)).when(is_l, part(text, legal, n))
    notation = F.when(is_s, "STATEMENT").when(is_l, "LEGAL")
    return F.struct(notation.alias("notation"), of(1).alias("lender"), of(2).alias("base"), of(3).alias("tail"), F.when(notation.isNotNull(), F.concat_ws("-", of(1), of(2), of(3))).alias("normalized"))


#: What is printed behind an indicator's unit, its status or the kinds of result that it stands for.
STATUS_WORDS = ("achieved", "not achieved", "not due", "off-track", "on-track", "partially achieved")
RESULT_TAGS = ("CRI", "DLI")


def indicator_name(c: Column) -> Column:
    """(name, unit, kind, tags, status) of a printed indicator: status words and tags after the last parenthesis, the unit
    and its kind inside it, and the name without any, case folded and white space collapsed."""
    close = F.length(c) - F.instr(F.reverse(c), ")") + 1  # the place of the last ')'; beyond the text without one
    behind = F.regexp_replace(F.trim(F.substr(c, close + 1, F.length(c))), r"\s+", " ")
    has = F.contains(c, F.lit(")"))
    # the longest status that ends what stands behind, as words of its own
    status = F.when(has, F.coalesce(*(F.when(F.endswith(F.concat(F.lit(" "), F.lower(behind)), F.lit(f" {w}")), F.substr(behind, F.length(behind) - len(w) + 1, F.lit(len(w)))) for w in sorted(STATUS_WORDS, key=len, reverse=True))))
    left = F.trim(F.when(status.isNotNull(), F.substr(behind, F.lit(1), F.length(behind) - F.length(status))).otherwise(behind))
    words = F.filter(F.split(left, " "), lambda w: w != "")
    all_tags = F.when(has, F.forall(words, lambda w: w.isin(*RESULT_TAGS))).otherwise(F.lit(False))
    tags = F.when(all_tags, words).otherwise(F.array().cast("array<string>"))
    whole = F.when(has & all_tags, F.substr(c, F.lit(1), close)).otherwise(F.when(status.isNotNull(), F.concat(F.substr(c, F.lit(1), close), F.lit(" "), left)).otherwise(c))
    # parentheses at the end, the last of which holds the unit, up to its first comma, and its kind
    groups = F.regexp_extract_all(F.regexp_extract(whole, r"((?:\s*\([^()]*\))+)\s*$", 1), F.lit(r"\(([^()]*)\)"), F.lit(1))
    parts = F.transform(F.split(F.try_element_at(groups, F.lit(-1)), ",", 2), lambda p: F.nullif(F.trim(p), F.lit("")))
    unit, kind = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    bare = F.regexp_replace(whole, r"(?:\s*\([^()]*\))+\s*$", "")
    name = F.lower(F.trim(F.regexp_replace(bare, r"[\s►➢]+", " ")))
    return F.struct(name.alias("name"), unit.alias("unit"), kind.alias("kind"), tags.alias("tags"), status.alias("status"))


def expanded(c: Column, acronyms: dict[str, str]) -> Column:
    """A question with the long forms of its acronyms appended, in the order of the table; matched as whole words."""
    return F.concat_ws(" ", c, *(F.when(c.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}]){a}(?:$|[^\p{{L}}\p{{N}}])"), long) for a, long in acronyms.items()))


def snippet(c: Column, found: str, around: int = 40) -> Column:
    """A text's first place of ``found`` with so many characters before and after it; null where it isn't."""
    at = F.instr(c, found)
    return F.when(at > 0, F.substr(c, F.greatest(F.lit(1), at - around), F.lit(2 * around + len(found)) - F.greatest(F.lit(0), around + 1 - at)))


def quoted_name(name: str) -> str:
    """An SQL identifier in back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def quoted_text(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rank_of(c: Column, scale: tuple[str, ...]) -> Column:
    """The place of a value on an ordinal scale, 1 first; what isn't on it has none."""
    return F.create_map(*(x for i, v in enumerate(scale) for x in (F.lit(v), F.lit(i + 1))))[c]


def flattened(df: DataFrame, column: str, prefix: str) -> list[Column]:
    """The fields of a struct column as columns of their own; nested ones and arrays as JSON."""
    out = []
    for f in df.schema[column].dataType.fields:
        c = F.col(column)[f.name]
        out.append((F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c).alias(f"{prefix}{f.name}"))
    return out


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """A row as JSON that is equal for equal rows: names sorted, decimals as text of their scale, dates in ISO, nulls kept."""
    one = lambda n: F.col(n).cast("string") if isinstance(df.schema[n].dataType, (T.DecimalType, T.DateType, T.TimestampType)) else F.col(n)
    return F.to_json(F.struct(*(one(n).alias(n) for n in sorted(columns))), {"ignoreNullFields": "false"})


def pruned_json(df: DataFrame, dropped: tuple[str, ...]) -> Column:
    """A row as JSON without the named columns, nulls, and empty texts and arrays."""
    kept = []
    for f in df.schema.fields:
        if f.name not in dropped:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StringType):
                c = F.nullif(c, F.lit(""))
            elif isinstance(f.dataType, T.ArrayType):
                c = F.when(F.size(c) > 0, c)
            kept.append(c.alias(f.name))
    return F.to_json(F.struct(*kept))


def payload_strings(rows: DataFrame, key: str, payload: str, depth: int = 4) -> DataFrame:
    """(key, path, value): every scalar of a JSON payload as text, objects and arrays opened to ``depth`` levels; what is
    nested deeper stays JSON text."""
    level = rows.select(key, F.lit("$").alias("path"), F.try_parse_json(payload).alias("v")).filter("v is not null")
    out = None
    for i in range(depth + 1):
        is_open = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)") if i < depth else F.lit(False)
        text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))
        leaves = level.filter(~is_open).select(key, "path", text.alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        if i < depth:
            inner = level.filter(is_open).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
            step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
            level = inner.select(level[key], F.concat(F.col("path"), step).alias("path"), F.col("value").alias("v"))
    return out


def date_forms(c: Column) -> Column:
    """The five ways in which a date is printed in answers."""
    return F.array(*(F.date_format(c, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy")))


def report_date(header: Column, archive: Column) -> Column:
    """(day, basis, difference): the header's date, else the archive's; both known, how many days lie between them."""
    basis = F.when(header.isNotNull(), "HEADER").when(archive.isNotNull(), "ARCHIVE").otherwise("UNKNOWN")
    return F.struct(F.coalesce(header, archive).alias("day"), basis.alias("basis"), F.abs(F.datediff(header, archive)).alias("difference"))


def unwrapped_number(c: Column) -> Column:
    """A number without the spaces that a line wrap put inside it."""
    return F.regexp_replace(F.trim(c), r"(?<=[0-9,.])\s+(?=[0-9,.])", "")
