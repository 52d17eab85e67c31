"""Workbooks, source files, sinks and tables."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import types as T

from tallyforge.operators import evaluation, grammar, quality, scope
from tallyforge.sources import bronze, excel
from tallyforge.sources.files import inventory

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(rows):
    shared = sorted({v for r in rows for v in r if isinstance(v, str)})
    cells = []
    for i, r in enumerate(rows, 1):
        one = "".join(f'<c r="{chr(65 + j)}{i}" t="s"><v>{shared.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None)
        cells.append(f'<row r="{i}">{one}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets><sheet name="Projects" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    rows = [["Banner"], [], ["Project ID", "Cost", "Other"], ["project_id", "cost", None], ["P1", 12.5, "x"], ["P2", None, " y "], [" ", None, None], ["P3", "1,000", None]]
    (tmp_path / "book.xlsx").write_bytes(workbook(rows))
    contract = {"projects": ("Projects", {"project_id": ("Project ID",), "cost": ("Cost",)}, ("project_id", "cost"))}
    got = excel.read_workbook(spark, str(tmp_path / "*.xlsx"), contract)["projects"].orderBy("row_no").collect()
    assert [(r["project_id"], r["cost"], r["row_no"]) for r in got] == [("P1", "12.5", 5), ("P2", None, 6), ("P3", "1,000", 8)]
    assert got[0]["_extra_fields"] == {"Other": "x"} and got[0]["_file"].endswith("book.xlsx")
    with pytest.raises(excel.SheetError, match="no sheet Loans"):
        list(excel.sheet_rows(workbook(rows), "Loans"))


def test_sources(spark, tmp_path):
    (tmp_path / "loans_1.csv").write_text("Banner\nProject,Loan Number,Amount\nP1,IBRD86010,5\nP2,8601-in,6\nP9,x,7\n")
    aliases = {"project_id": ("Project",), "loan_number": ("Loan Number",), "amount": ("Amount",)}
    sources = {"loans": (str(tmp_path / "loans_*.csv"), lambda s, p: bronze.read_loans(s, p, aliases, tuple(aliases), ["P1", "P2"]))}
    got = {r["project_id"]: r["normalized_loan_number"] for r in bronze.ingest(spark, sources)["loans"].collect()}
    assert got == {"P1": "IBRD-8601-0", "P2": "8601-IN"}
    (tmp_path / "loans_2.csv").write_text("x")
    with pytest.raises(bronze.SourceError, match="loans: .* matches 2 files"):
        bronze.ingest(spark, sources)
    with pytest.raises(bronze.SourceError, match="matches 0 files"):
        bronze.exactly_one(spark, str(tmp_path / "none*"))
    files = inventory(spark, str(tmp_path), {r"\.csv$": "CSV"})
    rows, identity = bronze.manifest(files)
    assert rows.count() == 2 and bronze.manifest(files.repartition(3))[1] == identity
    first = files.orderBy("path").limit(1).select("sha256")
    parsed = first.selectExpr("sha256", "'c1' as config_hash")
    assert bronze.to_parse(files, parsed, "c1").count() == 1 and bronze.to_parse(files, parsed, "c2").count() == 2


def test_sinks_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, 'a "b"')], "id long, name string")
    bronze.write_jsonl(rows.orderBy("id").coalesce(1), str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"id": 1, "name": 'a "b"'}, {"id": 2, "name": None}]
    bronze.write_review_csv(rows, str(tmp_path / "c"), ["id"])
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1 and spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).count() == 2
    schema = T.StructType([T.StructField("id", T.LongType(), False, {"comment": "the 'key'"}), T.StructField("na`me", T.StringType())])
    sql = bronze.create_table_sql("s.t", schema, "rows", {"a": "b"})
    assert sql == "CREATE TABLE IF NOT EXISTS `s`.`t` (`id` bigint NOT NULL COMMENT 'the \\'key\\'', `na``me` string) USING parquet COMMENT 'rows' TBLPROPERTIES ('a' = 'b')"
    with pytest.raises(bronze.SourceError, match="no table"):
        bronze.validate_table(spark, "nowhere_to_be_found", schema)


def test_choices_and_checks(spark):
    runs = [{"name": "a", "m": 0.5}, {"name": "b", "m": None}, {"name": "c", "m": 0.51}, {"name": "d", "m": 0.55}]
    best, why = evaluation.staged_choice(runs, "m", 0.02)
    assert best["name"] == "d" and why[0] == "b did not run" and len(why) == 3
    with pytest.raises(quality.UnknownCode):
        quality.found(spark.range(1), spark.range(1)["id"], {"NO_SUCH": spark.range(1)["id"] > 0})


def test_grammar_edges(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("d", 1, 1, 1, ["Name", None, "x"]), ("d", 1, 1, 2, None)], "document_id string, page int, table_no int, row_no int, cells array<string>")
    assert grammar.rated_rows(rows, {"Name": "N"}, {"current": "current"}).count() == 0
    assert grammar.wide_rows(rows.limit(0), 4).count() == 0 and grammar.rendered(rows).count() == 1
    kinds = spark.createDataFrame([(["Disbursement Linked Indicator"],), (["Loan", "Baseline", "Target"],), (["Baseline", "Target"],), (["x"],), ([],)], "c array<string>")
    assert [r[0] for r in kinds.select(grammar.table_kind(F.col("c"))).collect()] == ["DLI", None, "WIDE", None, None]
    lines = spark.createDataFrame([("d", 1, 1, "Name (a"), ("d", 1, 2, "b"), ("d", 1, 3, "c"), ("d", 1, 4, "d"), ("d", 1, 5, "e"), ("d", 1, 6, "f)")], "document_id string, page int, line_no int, text string")
    assert grammar.completed(lines, F.startswith("text", F.lit("Name"))).first()["name"] == "Name (a"  # it closes too late
    chunks = spark.createDataFrame([(1, None), (1, "2020-01-01"), (2, "2020-01-01"), (None, "2020-01-01")], "project_id long, d string").selectExpr("project_id", "'RETRIEVAL' as chunk_role", "cast(d as date) as document_date")
    assert scope.scoped(chunks, scope.Scope(1, since="2019-01-01")).count() == 1 and scope.scoped(chunks, scope.Scope(1)).count() == 2
