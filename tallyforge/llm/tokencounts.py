"""Operator 13: token counts through a cache of content digests.

A text's key is the SHA-256 of its normalised content, a cache's folder is named by the digest of the tokenizer's file,
library and rules. A run joins the corpus' distinct digests with the stored counts, encodes one text of each digest that
is missing and appends the new counts; then every document takes its count by its digest. Texts move only where counts
are missing, one of each digest and task, and not at all where the missing digests are few enough to be broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, workspace
from .subwords import ids_of, public_path, version

TOKENIZER = "byte_bpe_50k.json"
#: Texts that are encoded at once hold about so many characters.
AT_ONCE = 1 << 19
_SCHEMA = "digest binary, n_tokens long"


def normalised(text: Column) -> Column:
    """What is digested and counted: a null text is the empty one. Nothing else is unified, since these tokenizers count
    each other difference."""
    return F.coalesce(text, F.lit(""))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Stored counts, one for each digest: runs that were at work together may both have appended one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, path: str | None, name: str) -> DataFrame:
    """(digest, n_tokens) of every row of (digest, text), in batches bounded by characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or public_path(name)
        for b in batches:
            held, size, counts = [], 0, []

            def count(held: list[str]) -> list[int]:
                return [len(ids) for ids in ids_of(file, held)]

            for x in b.column("text"):
                held.append(x.as_py())
                size += len(held[-1])
                if size >= AT_ONCE:
                    counts += count(held)
                    held, size = [], 0
            counts += count(held)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, _SCHEMA)


def counted(docs: DataFrame, cache: str | None = None, path: str | None = None, name: str = TOKENIZER, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    ``cache``: a folder that all executors share; what earlier runs counted there is not encoded again (None: a new one
    for this call). ``path``: the tokenizer's file on every machine (None: the public one of that ``name``), read as its
    library reads it by default. Null and empty texts have 0 bytes and no tokens; equal texts, and repeated rows, are
    encoded once and each keeps its row; a null doc_id stays; an empty table gives no rows; other columns are not looked
    at. Whole texts are counted however long. A run that dies while it appends leaves the cache as it was, or with counts
    that are right; the next run counts what is missing.
    """
    spark = docs.sparkSession
    folder = f"{cache or f'{workspace(spark)}/token-counts-{uuid.uuid4().hex[:8]}'}/tokenizer={version(path or public_path(name))}"
    size = F.octet_length(normalised(F.col("text"))).cast("long").alias("n_bytes")
    keyed = stage(docs.select("doc_id", size, _digest(F.col("text")).alias("digest")), "digests")
    distinct = stage(keyed.select("digest").distinct(), "distinct-digests")
    missing = stage(distinct.join(_stored(spark, folder), "digest", "left_anti"), "missing-digests")
    texts = docs.select(_digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("text"))
    one_each = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
    if not missing.isEmpty():
        _encoded(one_each, path, name).write.mode("append").parquet(folder)
    counts = stage(distinct.join(_stored(spark, folder), "digest"), "counts-of-digests")
    n = F.coalesce("n_tokens", F.lit(0).cast("long"))
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
