"""Scans of CSV, JSON lines and files, all text first, with lineage and counts; and the checks of what was found."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 20


def _folded(text: str | None) -> str:
    return " ".join((text or "").split()).casefold()


def resolve_header(rows: list[list[str | None]], aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> tuple[int, dict[str, int], dict[str, int]]:
    """(row, column by field, column by unmapped header) of the first row that has an alias of each required field."""
    best: list[str] = list(required)
    for at, row in enumerate(rows):
        heads = {_folded(h): i for i, h in enumerate(row) if _folded(h)}
        found = {f: heads[_folded(a)] for f, names in aliases.items() for a in (f, *names) if _folded(a) in heads}
        missing = [f for f in required if f not in found]
        if not missing:
            used = set(found.values())
            return at, found, {" ".join(row[i].split()): i for i in heads.values() if i not in used}
        best = min(best, missing, key=len)
    raise ValueError(f"no header row has {', '.join(best)}")


def numbered_records(raw: DataFrame) -> DataFrame:
    """``raw``, read from text files, with (_file, _record): each record's number in its file, from 1.

    A file is read in blocks by many tasks. The records of each block are counted, the counts of the blocks before it are
    summed, and a record's number is that sum and its place in its block. Only blocks of a file meet in a task.
    """
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__order"))
    counts = rows.groupBy("_file", "__block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_file").alias("__f"), F.col("__block").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    # ids grow in the order in which a task reads; a block is read by one task
    inside = F.row_number().over(Window.partitionBy("_file", "__block").orderBy("__order"))
    rows = rows.withColumn("__inside", inside).join(starts, (F.col("_file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return rows.withColumn("_record", (F.col("__start") + F.col("__inside")).cast("long")).drop("__block", "__order", "__inside", "__f", "__b", "__start")


def read_csv(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...], multiline: bool = True) -> DataFrame:
    """A CSV's fields as text, its unmapped columns as a map, its file and each record's number in it; banner, header and
    second header rows go by their place in the file, blank rows wherever they stand.

    Only the first rows come to the driver, to find the header; the rest is read by executors. A byte order mark is
    dropped. ``multiline``: a quoted field may hold line breaks, so a file is read by one task; without, files are read
    in blocks. Records are counted as Spark reads them: lines without any character are none.
    """
    # a banner of fewer cells must not decide how many columns there are
    lines = [r[0] for r in spark.read.text(path).limit(HEAD).collect()]
    width = max((len(r) for r in csv.reader(io.StringIO("\n".join(lines)))), default=1)
    raw = spark.read.schema(", ".join(f"_c{i} string" for i in range(max(1, width)))).option("header", False).option("multiLine", multiline).option("escape", '"').csv(path)
    names = raw.columns
    head = [[(v or "").removeprefix("\ufeff") for v in r] for r in raw.limit(HEAD).collect()]
    at, fields, rest = resolve_header(head, aliases, required)
    clean = [F.coalesce(F.regexp_replace(F.col(c), "^\ufeff", ""), F.lit("")) for c in names]
    unmapped = F.map_from_entries(F.array(*(F.struct(F.lit(h).alias("k"), F.col(names[i]).alias("v")) for h, i in rest.items()))) if rest else F.create_map().cast("map<string,string>")
    second = F.col("_record") == at + 2  # a second header repeats the names right below the first
    for f, i in fields.items():
        second &= F.lower(F.trim(F.coalesce(F.col(names[i]), F.lit("")))).isin(_folded(f), *(_folded(a) for a in aliases[f]))
    blank = F.concat_ws("", *(F.trim(c) for c in clean)) == ""
    rows = numbered_records(raw).filter((F.col("_record") > at + 1) & ~second & ~blank)
    return rows.select(*(F.col(names[i]).cast("string").alias(f) for f, i in fields.items()), unmapped.alias("_extra_fields"), "_file", "_record")


def scoped(rows: DataFrame, column: str, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose canonical id is in scope, and one row of counts (scanned, no_id, kept)."""
    canonical = F.upper(F.trim(F.col(column)))
    kept = canonical.isin(*ids)
    counts = rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(canonical.isNull() | (canonical == "")).alias("no_id"), F.count_if(kept).alias("kept"))
    return rows.where(kept), counts


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def inventory(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """(path, size, sha256, kind) of every file; the first pattern that a name matches classifies it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.coalesce(*(F.when(F.col("path").rlike(p), k) for p, k in kinds.items()), F.lit("UNCLASSIFIED"))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def verified(manifest: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): MATCH, MISMATCH, MISSING or UNEXPECTED for each key of either side."""
    m, f = manifest.select(F.col(key).alias("__m"), F.col(digest).alias("__hm")), found.select(F.col(key).alias("__f"), F.col(digest).alias("__hf"))
    status = F.when(F.col("__m").isNull(), "UNEXPECTED").when(F.col("__f").isNull(), "MISSING").when(F.col("__hm") == F.col("__hf"), "MATCH").otherwise("MISMATCH")
    return m.join(f, F.col("__m") == F.col("__f"), "full").select(F.coalesce("__m", "__f").alias(key), status.alias("status"))
