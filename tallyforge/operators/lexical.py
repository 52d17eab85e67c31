"""A lexical index that is kept: postings as Parquet, and BM25 search that reads those of the questions' terms only.

Search is exact. Each posting of a term that is asked is shuffled once, whatever number of questions has the term, to the
part of its document; ``retrieval.best_sums`` adds up a document's score for each question there and passes on k documents
of each part, so that no pair of a question and a document, and no pair of those and a term, is ever a row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.arrays import let
from tallyforge.functions.text import search_tokens
from tallyforge.operators.retrieval import FEW, K1, PART, B, best_sums
from tallyforge.staging import shared_folder, staged

#: Postings are dealt to so many folders by their term's hash.
BUCKETS = 16
#: Up to so many terms are named to the scan, which then skips row groups that hold none of them.
NAMED = 256


def term_counts(tokens: Column) -> Column:
    """(term, tf) of an array of tokens, in one sort of the array."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda first: F.transform(first, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(first, k + 1), n) - i).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return let(tokens, lambda t: F.when(F.size(t) > 0, let(F.array_sort(t), of_sorted)).otherwise(none))


@dataclass(frozen=True)
class Index:
    """Where an index lies: folders of postings (term, doc, tf, length) by bucket, and of terms (term, df, cf, number); the number of
    documents and their mean length."""

    folder: str
    documents: int
    mean_length: float

    def part(self, tf: Column, length: Column) -> Column:
        """A term's share of a document's score, but for its rarity."""
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.mean_length)))

    def rarity(self, df: Column) -> Column:
        return F.log1p((F.lit(self.documents) - df + 0.5) / (df + 0.5))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(corpus: DataFrame, key: str, text: str, folder: str) -> Index:
    """Index the texts of ``corpus`` under a new folder. Documents without tokens count; a null text has none; keys are
    unique."""
    spark = corpus.sparkSession
    path = f"{folder}/{uuid.uuid4().hex[:8]}"
    tokens = F.coalesce(search_tokens(F.col("text")), F.array().cast("array<string>"))
    rows = corpus.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    n = rows.count()
    # texts are shuffled, not their many postings: a task cuts, sorts and writes those of about PART documents
    dealt = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // PART)), F.xxhash64("doc"))
    postings = dealt.select("doc", tokens.alias("t")).select("doc", F.size("t").alias("length"), F.inline(term_counts(F.col("t")))).withColumn("bucket", _bucket(F.col("term")))
    postings.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    kept = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{path}/terms")
    total = spark.read.parquet(f"{path}/terms").agg(F.sum("cf")).first()[0] or 0
    index = Index(path, n, total / n if total else 1.0)
    return index


def search(spark: SparkSession, index: Index, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by BM25, ties by document; only scores over zero."""
    asked = queries.select(query_key, F.explode(F.array_distinct(search_tokens(F.col(query_text)))).alias("term"))
    terms = asked.join(spark.read.parquet(f"{index.folder}/terms"), "term")
    terms = staged(terms.select(query_key, "term", "number", index.rarity(F.col("df")).alias("idf"), _bucket(F.col("term")).alias("bucket")), index.folder, "asked")
    n = terms.count()
    small = F.broadcast if n <= FEW else lambda df: df
    postings = spark.read.parquet(f"{index.folder}/postings")
    postings = postings.filter(F.col("bucket").isin([r[0] for r in terms.select("bucket").distinct().collect()]))  # BUCKETS at most
    if n <= NAMED:
        postings = postings.filter(F.col("term").isin([r[0] for r in terms.select("term").distinct().collect()]))
    parts = postings.join(small(terms.select("term", "number").distinct()), "term").select("doc", "number", index.part(F.col("tf"), F.col("length")).alias("part"))
    return best_sums(parts, "doc", terms.select(query_key, "number", "idf"), query_key, k, index.documents)


_kept: dict[tuple, Index] = {}


def kept(corpus: DataFrame, key: str, text: str) -> Index:
    """The index of a table that is read from files, built once by an application for as long as those files stay as they
    are: their paths, sizes and times name it."""
    spark = corpus.sparkSession
    files = corpus.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    print_of = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    name = (spark.sparkContext.applicationId, key, text, tuple(print_of))
    if name not in _kept:
        _kept[name] = build(corpus, key, text, shared_folder(spark))
    return _kept[name]
