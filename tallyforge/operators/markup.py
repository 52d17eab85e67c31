"""Markup as rows: HTML texts to blocks of text by built-in expressions, to cells of tables by one pass over a text's tokens.

A text is cut into tokens: comments, scripts, tags and runs of text. Nesting is a running sum over the tags of tables; at
each depth the last tag of a table, row, section or cell says what is open, so end tags that are missing, doubled or out
of place need no repair. What html says of malformed markup beyond that is not followed: text between rows is in no cell.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import collapse

#: A ``<`` that begins none of these is text. Quantifiers are possessive: no text makes the search go back far.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*+>.*?(?:</(?:script|style)\s*+>|\z)|<[!?][^>]*+>"
    r"""|</?[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
)
#: Elements that begin a line of their own.
BLOCK_TAGS = tuple(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li "
    "main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
#: What a table's tags do to its row: begin it, leave it open, end it.
_CELLS, _ENDS = ("td", "th"), ("table", "tbody", "thead", "tfoot", "caption")


def decoded(c: Column) -> Column:
    """Text with its character references resolved: decimal, hexadecimal and named ones that end with a semicolon. A number
    that is no character is U+FFFD; an unknown name stays."""
    names = F.create_map(*(F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))))
    part = F.regexp_extract_all(c, F.lit(r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*+);|[^&]++|&)"), F.lit(1))

    def one(x: Column) -> Column:
        body = F.substr(x, F.lit(3), F.length(x) - 3)
        code = F.when(F.lower(F.substr(x, F.lit(3), F.lit(1))) == "x", F.conv(F.substr(x, F.lit(4), F.length(x) - 4), 16, 10)).otherwise(body).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        numbered = F.startswith(x, F.lit("&#")) & F.endswith(x, F.lit(";"))
        return F.when(numbered, char).when(F.startswith(x, F.lit("&")), F.coalesce(F.try_element_at(names, F.substr(x, F.lit(2), F.length(x) - 2)), x)).otherwise(x)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(part, one), "")).otherwise(c)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, or null."""
    found = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, found, i), F.lit("")) for i in (1, 2, 3)))


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, token, tag, closes): the tokens of each text in order; ``tag`` is null for text; comments, declarations,
    scripts and styles are left out. A null or empty text has no tokens."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    name = F.lower(F.regexp_extract("token", r"(?s)^</?([A-Za-z][^\s/>]*)", 1))
    whole = F.endswith("token", F.lit(">"))
    rows = rows.select("*", F.when((name != "") & whole, name).alias("tag"), F.startswith("token", F.lit("</")).alias("closes"))
    return rows.filter("not startswith(token, '<!') and not startswith(token, '<?') and (tag is null or tag not in ('script', 'style'))")


def _joined(value: Column, at: str = "at") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value.alias("v")))), lambda x: x["v"]), "")


def _depth(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the depth of open tables after each token; an end tag without its start counts nothing."""
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__step", F.when(F.col("tag") == "table", F.when(F.col("closes"), -1).otherwise(1)).otherwise(0))
    rows = rows.withColumn("__sum", F.sum("__step").over(upto))
    return rows.withColumn("depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(upto))).drop("__sum")


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_no, kind, text): the runs of text outside tables between two tags of blocks, numbered from 1; ``kind`` is
    the tag that opens the run, 'text' after an end tag or before any. Blank runs are left out; inline tags join what is
    around them. Texts without any tag are one run; null and empty ones have none."""
    rows = _depth(tokens(pages, key, html), key)
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.col("tag").isin(*BLOCK_TAGS)
    rows = rows.withColumn("__nth", F.coalesce(F.sum(F.coalesce(edge.cast("int"), F.lit(0))).over(upto), F.lit(0)))
    kind = F.max(F.when(edge & ~F.col("closes"), F.col("tag")))
    runs = rows.groupBy(key, "__nth").agg(F.coalesce(kind, F.lit("text")).alias("kind"), _joined(F.when(F.col("tag").isNull() & (F.col("depth") == 0), F.col("token")).otherwise("")).alias("t"))
    runs = runs.withColumn("text", collapse(decoded(F.col("t")))).filter("text is not null")
    return runs.select(key, F.row_number().over(Window.partitionBy(key).orderBy("__nth")).cast("long").alias("block_no"), "kind", "text")


def cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, page, table_no, row_no, cell_no, column_no, is_head, colspan, rowspan, text): every cell of every table.

    Tables are numbered by their start tags in a text, rows and cells inside them, all from 1; ``column_no`` counts the
    columns that cells before it span. ``page`` is the last ``data-page`` before the table, else 1. A cell ends where the
    next cell, row, section or its table's end comes; a cell outside a row begins one; a table that never ends goes on to
    the text's end. Text belongs to the cell of the innermost open table. A blank cell has an empty text.
    """
    cut = F.coalesce(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    # a function of the row, so that rows stay where their keys were dealt to
    rows = pages.select(key, F.inline(F.arrow_udf(_cells_of, _CELL)(cut)))
    return rows.select(key, "page", "table_no", "row_no", "cell_no", "column_no", "is_head", "colspan", "rowspan", F.coalesce(collapse(decoded(F.col("t"))), F.lit("")).alias("text"))


_CELL = "array<struct<page: int, table_no: bigint, row_no: bigint, cell_no: bigint, column_no: bigint, is_head: boolean, colspan: int, rowspan: int, t: string>>"
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)", re.ASCII)
_WHOLE = re.compile(r"[+-]?[0-9]+\Z", re.ASCII)
_ATTRIBUTES = {n: re.compile(rf"""\s{n}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.ASCII | re.IGNORECASE) for n in ("data-page", "colspan", "rowspan")}
_BLANK = "".join(map(chr, [*range(33), 127]))


def _number(tag: str, name: str) -> int | None:
    """An attribute's value as Spark casts it to int, or null."""
    found = _ATTRIBUTES[name].search(tag) if name in tag.lower() else None
    value = next((g for g in found.groups() if g), "").strip(_BLANK) if found else ""
    return int(value) if _WHOLE.match(value) and -(1 << 31) <= int(value) < 1 << 31 else None


@lru_cache(1 << 12)
def _tag(token: str) -> tuple:
    """(tag, closes, word, data-page, colspan, rowspan) of a tag; ``word`` is what it does to a table's row. Null if it is
    left out; the tag is null where the token is text."""
    name = _NAME.match(token) if token.endswith(">") else None
    tag, closes = name.group(1).lower() if name else None, token.startswith("</")
    if token.startswith(("<!", "<?")) or tag in ("script", "style"):
        return None
    word = None
    if tag in _CELLS:
        word = "after" if closes else "cell"
    elif tag == "tr":
        word = "out" if closes else "row"
    elif tag in _ENDS:
        word = "out"
    return tag, closes, word, *(_number(token, a) if tag and not closes else None for a in ("data-page", "colspan", "rowspan"))


_TEXT = (None, False, None, None, None, None)


def _text_cells(found: list[str]) -> list[list]:
    """The cells of a text's tokens; see ``cells``."""
    out, last, tables, depth, n, page = [], {}, {}, 0, 0, 1
    for token in found:
        got = _tag(token) if token[0] == "<" else _TEXT
        if got is None:
            continue
        tag, closes, word, paged, wide, high = got
        level = depth
        if tag == "table":
            if closes:
                level, depth = max(depth, 1), max(depth - 1, 0)
            else:
                n, level = n + 1, depth + 1
                depth, last[level] = level, n
        page = page if paged is None else paged
        if not level or level not in last:
            continue
        number = last[level]
        if number not in tables:
            # the last word, the last that is no end of a cell, rows, cells of the row, columns, the open cell
            tables[number] = [None, None, 0, 0, 0, None]
        t = tables[number]
        if word == "row" or (word == "cell" and t[1] in (None, "out")):
            t[2:] = [t[2] + 1, 0, 0, None]
        if word == "cell":
            wide, high = max(1, wide or 1), max(1, high or 1)
            t[3] += 1
            t[5] = [page, number, t[2], t[3], t[4] + 1, tag == "th", wide, high, []]
            t[4] += wide
            out.append(t[5])
        elif t[5]:
            t[5][0] = min(t[5][0], page)
            if (word or t[0]) == "cell":
                t[5][8].append(token if tag is None else " " if tag in BLOCK_TAGS else "")
        if word:
            t[0] = word
            t[1] = t[1] if word == "after" else word
    return out


def _rows_of(texts: pa.Array) -> pa.Array:
    """The rows of each array of tokens; a cell that spans columns is followed by blank ones."""
    rows, cells, row_ends, ends = [], [], [0], [0]
    for found in texts.to_pylist():
        held = {}
        for c in _text_cells(found):
            held.setdefault((c[0], c[1], c[2]), []).extend(["".join(c[8]), *[""] * (c[6] - 1)])
        for at, texts_ in held.items():
            rows.append(at)
            cells += texts_
            ends.append(len(cells))
        row_ends.append(len(rows))
    numbers = [pa.array(c, pa.int32()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)]
    held = pa.StructArray.from_arrays([*numbers, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells, pa.string()))], ["page", "table_no", "row_no", "cells"])
    return pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), held)


def _cells_of(texts: pa.Array) -> pa.Array:
    """The cells of each array of tokens."""
    cells, ends = [], [0]
    for found in texts.to_pylist():
        cells += [(*c[:8], "".join(c[8])) for c in _text_cells(found)]
        ends.append(len(cells))
    kinds = [("page", pa.int32()), *((c, pa.int64()) for c in ("table_no", "row_no", "cell_no", "column_no")), ("is_head", pa.bool_()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("t", pa.string())]
    columns = list(zip(*cells, strict=True)) or [[]] * len(kinds)
    rows = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def read_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``table_rows`` of the ``cells`` of texts whose keys are unique, without a row for each cell."""
    cut = F.coalesce(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    kind = "array<struct<page: int, table_no: int, row_no: int, cells: array<string>>>"
    rows = pages.select(F.col(key).alias("document_id"), F.inline(F.arrow_udf(_rows_of, kind)(cut)))
    return rows.withColumn("cells", F.transform("cells", lambda t: F.coalesce(collapse(decoded(t)), F.lit(""))))


def table_rows(found: DataFrame, key: str) -> DataFrame:
    """(document_id, page, table_no, row_no, cells): the cells of a row as an array, as the grammars of reports read them; a
    cell that spans columns is followed by blank ones."""
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text", "colspan"))), lambda x: F.concat(F.array(x["text"]), F.array_repeat(F.lit(""), x["colspan"] - 1))))
    rows = found.groupBy(F.col(key).alias("document_id"), "page", "table_no", "row_no").agg(texts.alias("cells"))
    return rows.select("document_id", "page", F.col("table_no").cast("int").alias("table_no"), F.col("row_no").cast("int").alias("row_no"), "cells")
