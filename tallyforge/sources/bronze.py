"""Bronze: which file a source is, how it is read, and where tables, lines and reviews are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.records import loan_number, quoted_name, quoted_text
from tallyforge.operators.merkle import root
from tallyforge.sources.files import read_csv, scoped


class SourceError(ValueError):
    """A source, a table or an object that is not as its contract says."""


def exactly_one(spark: SparkSession, pattern: str) -> str:
    """The only file that a pattern of the cluster's file system matches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(f.getPath()) for f in found or [])
    if len(names) != 1:
        raise SourceError(f"{pattern} matches {len(names)} files{': ' + ', '.join(names) if names else ''}")
    return names[0]


def read_loans(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...], ids: list[str], key: str = "project_id", number: str = "loan_number") -> DataFrame:
    """The loans of the projects in scope, with their number's normalised form beside the printed one."""
    rows, _ = scoped(read_csv(spark, path, aliases, required), key, ids)
    return rows.withColumn("normalized_loan_number", loan_number(F.col(number))["normalized"])


def read_procurement(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...], ids: list[str], key: str = "project_id") -> DataFrame:
    """The contract awards of the projects in scope; a contract may stand on several rows, one for each supplier."""
    return scoped(read_csv(spark, path, aliases, required), key, ids)[0]


def ingest(spark: SparkSession, sources: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]]) -> dict[str, DataFrame]:
    """A frame for each source: the one file of its pattern, read by its reader. All patterns are resolved before anything is
    read, and all that do not match one file are named."""
    files, wrong = {}, []
    for name, (pattern, _) in sources.items():
        try:
            files[name] = exactly_one(spark, pattern)
        except SourceError as e:
            wrong.append(f"{name}: {e}")
    if wrong:
        raise SourceError("; ".join(wrong))
    return {name: read(spark, files[name]) for name, (_, read) in sources.items()}


def manifest(files: DataFrame) -> tuple[DataFrame, str]:
    """The (path, size, sha256) of an inventory, and the snapshot's identity: the root of a hash tree over its paths and
    contents, whatever their order."""
    rows = files.select("path", "size", "sha256")
    return rows, root(rows, ["path"])


def to_parse(files: DataFrame, parsed: DataFrame, config_hash: str) -> DataFrame:
    """The files that no parsed document is kept of, by content and configuration: both decide what parsing gives."""
    kept = parsed.filter(F.col("config_hash") == config_hash).select("sha256")
    return files.join(kept, "sha256", "left_anti").dropDuplicates(["sha256"]).withColumn("config_hash", F.lit(config_hash))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls kept, so that every line has every field."""
    rows.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_review_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """One sorted CSV file for people to review: a small table, since it becomes one file."""
    rows.orderBy(*order).coalesce(1).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def create_schema_sql(name: str) -> str:
    return f"CREATE SCHEMA IF NOT EXISTS {quoted_name(name)}"


def create_table_sql(name: str, schema: T.StructType, comment: str = "", properties: dict[str, str] | None = None) -> str:
    """The statement that makes a table of a contract: types, NOT NULL, comments and properties."""
    columns = []
    for f in schema.fields:
        said = f.metadata.get("comment", "")
        columns.append(f"{quoted_name(f.name)} {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") + (f" COMMENT {quoted_text(said)}" if said else ""))
    of = ", ".join(f"{quoted_text(k)} = {quoted_text(v)}" for k, v in sorted((properties or {}).items()))
    table = ".".join(map(quoted_name, name.split(".")))
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)}) USING parquet" + (f" COMMENT {quoted_text(comment)}" if comment else "") + (f" TBLPROPERTIES ({of})" if of else "")


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, comment: str = "") -> None:
    """Make a table, or check that the one there has the contract's columns and types."""
    if "." in name:
        spark.sql(create_schema_sql(name.split(".")[0]))
    spark.sql(create_table_sql(name, schema, comment))
    validate_table(spark, name, schema)


def validate_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    if not spark.catalog.tableExists(name):
        raise SourceError(f"there is no table {name}")
    want = {f.name: f.dataType.simpleString() for f in schema.fields}
    have = {f.name: f.dataType.simpleString() for f in spark.table(name).schema.fields}
    wrong = [f"{c} is {have.get(c, 'missing')}, not {t}" for c, t in want.items() if have.get(c) != t] + [f"{c} is not of the contract" for c in have if c not in want]
    if wrong:
        raise SourceError(f"{name}: {'; '.join(wrong)}")
