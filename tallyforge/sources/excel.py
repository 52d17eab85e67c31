"""Sheets of Excel workbooks as rows of text, read on executors from the workbook's own XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.files import HEAD, resolve_header


class SheetError(ValueError):
    """A workbook that lacks a sheet of its contract."""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column(reference: str) -> int:
    """The place of a cell's column from 0: A is 0, AA is 26."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet's rows that hold anything; numbers are text as stored, truth values TRUE and FALSE."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name))
        names = {}
        for s in parse("xl/workbook.xml").iter():
            if _local(s.tag) == "sheet":
                names[s.attrib["name"]] = next(v for k, v in s.attrib.items() if _local(k) == "id")
        if sheet not in names:
            raise SheetError(f"no sheet {sheet}; there are {', '.join(sorted(names))}")
        targets = {r.attrib["Id"]: r.attrib["Target"].lstrip("/") for r in parse("xl/_rels/workbook.xml.rels")}
        target = targets[names[sheet]]
        shared = [_text(s) for s in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if _local(row.tag) != "row":
                    continue
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.attrib["r"]) if "r" in c.attrib else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = next((v.text for v in c if _local(v.tag) == "v"), None)
                    kind = c.attrib.get("t")
                    cells[at] = shared[int(value)] if kind == "s" and value else _text(c) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value) if kind == "b" else value
                if any(x and x.strip() for x in cells):
                    yield int(row.attrib.get("r", 0)), cells
                row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(_file, row_no, cells) of a sheet of each workbook under ``path``; a workbook without it fails the read. A workbook
    is one task's work, since it is one compressed file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = list(sheet_rows(content, sheet))
                yield pd.DataFrame({"_file": [file] * len(rows), "row_no": [n for n, _ in rows], "cells": [c for _, c in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "_file string, row_no long, cells array<string>")


def read_fields(spark: SparkSession, path: str, sheet: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """A sheet's fields as text below its header row, its unmapped columns as a map, and its file and row number. A second
    header row, all of whose fields are aliases, is left out."""
    rows = read_sheet(spark, path, sheet)
    head = rows.orderBy("_file", "row_no").limit(HEAD).collect()
    at, fields, rest = resolve_header([[v or "" for v in r["cells"]] for r in head], aliases, required)
    get = lambda i: F.get("cells", F.lit(i))
    names = {f: [" ".join(a.split()).casefold() for a in (f, *aliases[f])] for f in fields}
    second = F.lit(True)
    for f, i in fields.items():
        second &= F.lower(F.trim(F.coalesce(get(i), F.lit("")))).isin(*names[f])
    extra = F.map_from_entries(F.array(*(F.struct(F.lit(h).alias("k"), get(i).alias("v")) for h, i in rest.items()))) if rest else F.create_map().cast("map<string,string>")
    below = rows.filter((F.col("row_no") > head[at]["row_no"]) & ~second)
    return below.select(*(get(i).alias(f) for f, i in fields.items()), extra.alias("_extra_fields"), "_file", "row_no")


def read_workbook(spark: SparkSession, path: str, sheets: dict[str, tuple[str, dict[str, tuple[str, ...]], tuple[str, ...]]]) -> dict[str, DataFrame]:
    """A table for each of ``sheets``: name of the table, and its sheet, aliases and required fields."""
    return {name: read_fields(spark, path, sheet, aliases, required) for name, (sheet, aliases, required) in sheets.items()}
