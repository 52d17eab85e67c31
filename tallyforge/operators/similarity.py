"""Near-identical names: joins of sets of words by their similarity, and of names of which one begins the other.

The similarity join looks at prefixes only: with a set's words in the order of their rarity, two sets of a Jaccard
similarity of t share one of their first n - ceil(t * n) + 1 words. Lengths and the places of the shared word bound the
overlap before whole sets are compared. Equal sets are one class; classes are compared, not their members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.staging import shared_folder, staged

#: Rows in a slice of a base name, and pairs that a task makes, about.
SLICE, PAIRS = 256, 1 << 21


def words_of(c: Column) -> Column:
    """The distinct words of a name, sorted: runs of lower-case letters and digits."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))


def classes(rows: DataFrame, block: list[str], key: str, name: str) -> DataFrame:
    """(block, key, class): the least key of the rows of a block with the same words; a name without words has none."""
    sets = rows.select(*block, key, words_of(F.col(name)).alias("__w")).filter("size(__w) > 0")
    least = sets.groupBy(*block, "__w").agg(F.min(key).alias("class"))
    return sets.join(least, [*block, "__w"]).select(*block, key, "class")


def similar(rows: DataFrame, block: list[str], key: str, name: str, threshold: float) -> DataFrame:
    """(block, key_a, key_b, shared, size_a, size_b, similarity) of the pairs of classes, key_a < key_b, whose sets of words
    have a Jaccard similarity of at least ``threshold``; a class is named by its least key. Pairs of one class are in
    ``classes``. Only rows of equal block values compare; null names and block values are in no pair."""
    sets = rows.select(*block, key, words_of(F.col(name)).alias("__w")).filter("size(__w) > 0").groupBy(*block, "__w").agg(F.min(key).alias("__key"))
    each = sets.select(*block, "__key", F.explode("__w").alias("__word"))
    rarity = each.groupBy("__word").agg(F.count(F.lit(1)).alias("__df"))
    ordered = each.join(rarity, "__word").groupBy(*block, "__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__df", "__word"))), lambda x: x["__word"]).alias("__w"))
    ordered = staged(ordered, shared_folder(rows.sparkSession), "ordered-words")  # both sides of both joins read it
    n = F.size("__w")
    # the least overlap, as a whole number; a hair less than t * n, since that is computed
    prefix = F.slice("__w", F.lit(1), (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))
    heads = ordered.select(*block, "__key", n.alias("__n"), F.posexplode(prefix).alias("__at", "__word"))
    a = heads.select(*block, "__word", F.col("__key").alias("key_a"), F.col("__n").alias("na"), F.col("__at").alias("pa"))
    b = heads.select(*block, "__word", F.col("__key").alias("key_b"), F.col("__n").alias("nb"), F.col("__at").alias("pb"))
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    # words before and after the shared one, and itself
    most = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    candidates = a.join(b, [*block, "__word"]).filter((F.col("key_a") < F.col("key_b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9) & (most >= need))
    candidates = candidates.select(*block, "key_a", "key_b").distinct()
    side = lambda k, w: ordered.select(*block, F.col("__key").alias(k), F.col("__w").alias(w))
    both = candidates.join(side("key_a", "wa"), [*block, "key_a"]).join(side("key_b", "wb"), [*block, "key_b"])
    both = both.withColumn("shared", F.size(F.array_intersect("wa", "wb"))).select(*block, "key_a", "key_b", "shared", F.size("wa").alias("size_a"), F.size("wb").alias("size_b"))
    jaccard = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    return both.withColumn("similarity", F.round(jaccard, 6)).filter(F.col("shared") >= threshold * (F.col("size_a") + F.col("size_b") - F.col("shared")) - 1e-9)


def base_name(c: Column) -> Column:
    """A name without units and types in parentheses at its end, lower case, with only its letters and digits."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?:\s*\([^()]*\))+\s*$", "")), r"[^\p{L}\p{N}]+", " "), F.lit(""))


def possible_matches(names: DataFrame, block: list[str], key: str, name: str, least: int = 30) -> DataFrame:
    """(block, key_a, key_b, reason) of names of a block that may be one: SAME_BASE where they are equal but for units, types
    and punctuation, PREFIX where the shorter one, of ``least`` characters at least, begins the other; nothing is merged.

    Only different base names meet: one is looked up by hash among the beginnings of the others. Rows of a base name stand
    in slices of about ``SLICE``; what becomes pairs are pairs of slices, in as many tasks as the pairs need.
    """
    rows = names.select(*block, F.col(key).alias("__key"), F.trim(base_name(F.col(name))).alias("__base")).filter("__base <> ''").filter(F.col("__key").isNotNull())
    folder = shared_folder(names.sparkSession)
    bases = staged(rows.groupBy(*block, "__base").agg(F.count(F.lit(1)).alias("__n")), folder, "bases")
    slice_ = F.pmod(F.xxhash64("__key"), F.ceil(F.col("__n") / SLICE)).cast("int").alias("__slice")
    slices = rows.join(bases, [*block, "__base"]).select(*block, "__base", "__key", slice_)
    slices = staged(slices.groupBy(*block, "__base", "__slice").agg(F.collect_list("__key").alias("__keys")), folder, "slices")
    side = lambda base, at, keys: slices.select(*block, F.col("__base").alias(base), F.col("__slice").alias(at), F.col("__keys").alias(keys))
    one, two = side("base_a", "at_a", "xs"), side("base_b", "at_b", "ys")
    same = one.join(two.withColumnRenamed("base_b", "base_a"), [*block, "base_a"]).filter("at_a <= at_b").select(*block, "xs", "ys", F.expr("at_a = at_b").alias("own"), F.lit("SAME_BASE").alias("reason"))
    long_ = bases.filter(F.length("__base") >= least)
    begins = F.transform(F.sequence(F.lit(least), F.length("__base") - 1), lambda n: F.xxhash64(F.substring(F.col("__base"), F.lit(1), n)))
    heads = long_.filter(F.length("__base") > least).select(*block, F.col("__base").alias("base_b"), F.explode(begins).alias("__hash"))
    met = long_.select(*block, F.col("__base").alias("base_a"), F.xxhash64("__base").alias("__hash")).join(heads, [*block, "__hash"]).filter(F.startswith("base_b", F.col("base_a")))
    prefix = met.select(*block, "base_a", "base_b").distinct().join(one, [*block, "base_a"]).join(two, [*block, "base_b"]).select(*block, "xs", "ys", F.lit(False).alias("own"), F.lit("PREFIX").alias("reason"))
    meeting = staged(same.unionByName(prefix), folder, "meeting")
    pairs = meeting.agg(F.sum(F.size("xs").cast("long") * F.size("ys"))).first()[0] or 0
    dealt = meeting.repartition(max(names.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS)))
    each = dealt.select("*", F.explode("xs").alias("x")).select(*block, "own", "reason", "x", F.explode("ys").alias("y"))
    each = each.filter(F.when(F.col("own"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return each.select(*block, F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "reason")
