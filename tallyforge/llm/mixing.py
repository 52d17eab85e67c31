"""Operator 1: mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source documents are ordered by that key, a distributed prefix sum of
their sizes gives each the words that stand before it, and the source's budget is cut at exactly that many words: whole
epochs first, then the documents whose words begin below what is left. No source is ordered in one task: its keys are
cut into ranges of about ``ROWS_PER_RANGE`` rows, the ranges are summed first, and only then are rows summed within theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, stage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
ROWS_PER_RANGE = 20_000
SEED = 20_240_501


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, n, source_size, target) for ``sizes`` (source, size), of which only one row for each source is gathered.

    Weights go round the sources in code-point order, null last. A target stops at ``max_epochs`` times its source's size;
    the excess is shared again by weight. With sources ordered by cap/weight the ones that stop are a prefix, so running
    sums find the level in one pass instead of a loop. Sources of size 0 have target 0.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", cap).withColumn("reach", F.col("cap") / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.sum("weight").over(whole.partitionBy()) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    per = per.withColumn("level", F.when(level <= F.col("reach"), level))
    final = F.max("level").over(whole.partitionBy())
    per = per.withColumn("final", final)
    target = F.when(F.col("final").isNull() | (F.col("reach") < F.col("final")), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return per.select("source", "n", "source_size", target.alias("target"))


def mixed_sizes(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size, tie) with source_size, target and taken: the words that the mix takes of each.

    Rows with equal doc_id and tie are alike, so which of them stands first changes nothing but their order.
    """
    key = F.xxhash64(F.lit(SEED), "doc_id", "tie")
    uniform = F.shiftrightunsigned(key, 1).cast("double") / F.lit(float(1 << 63))
    rows = sized.alias("d").join(F.broadcast(targets.alias("t")) if _few(targets) else targets.alias("t"), F.expr("d.source <=> t.source"))
    rows = rows.select("d.doc_id", "d.source", "d.size", "d.tie", "t.source_size", "t.target", key.alias("key"), F.floor(uniform * F.ceil(F.col("t.n") / ROWS_PER_RANGE)).alias("range"))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("r").join(ranges.alias("o"), F.expr("r.source <=> o.source and r.range = o.range")).select("r.*", (F.col("r.start") + F.col("o.below")).alias("begins"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("begins")))
    return rows.select("doc_id", "source", "size", "tie", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def _few(targets: DataFrame, most: int = 20_000) -> bool:
    """True if the sources are few enough to broadcast, whatever the number of documents."""
    return targets.limit(most + 1).count() <= most


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document of ``docs`` (doc_id, text, source).

    Null texts have size 0 and are taken 0 times; null sources form one source, ordered last; repeated rows count each
    for themselves; an empty table gives no rows; other columns are not looked at. Texts never leave the scan: what is
    shuffled is an id, a source, a size and a 64-bit hash.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    targets = stage(source_targets(sized, weights, max_epochs), "targets")
    return mixed_sizes(sized, targets).drop("tie")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as the mix takes it whole, and the one at
    which a source's budget ends also cut after the words that are left. Documents of which nothing is taken go; those
    without any word cost nothing and stay once. Of rows that are alike the first ones take the larger parts."""
    columns = docs.columns
    tie, nth, copy = (free_name(docs, x) for x in ("tie", "nth", "copy"))
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    plan = mixed_sizes(sized, stage(source_targets(sized, weights, max_epochs), "targets"))
    plan = plan.groupBy("doc_id", "source", "tie", "size").agg(F.sum("taken").alias("words"), F.count(F.lit(1)).alias("alike"))
    whole = F.floor(F.col("words") / F.greatest("size", F.lit(1)))
    plan = plan.select(F.col("doc_id").alias(f"{tie}_id"), F.col("source").alias(f"{tie}_source"), F.col("tie").alias(f"{tie}_text"), "size", whole.alias("whole"), (F.col("words") - whole * F.col("size")).alias("rest"), "alike")
    plan = plan.select(*(F.col(c).alias(c if c.startswith("__") or c.startswith("___") else f"{tie}_{c}") for c in plan.columns))
    rows = docs.withColumn(tie, F.xxhash64("text"))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", tie).orderBy(tie)))
    rows = rows.join(plan, F.col("doc_id").eqNullSafe(F.col(f"{tie}_id")) & F.col("source").eqNullSafe(F.col(f"{tie}_source")) & F.col(tie).eqNullSafe(F.col(f"{tie}_text")))
    size, full, rest, alike = (F.col(f"{tie}_{c}") for c in ("size", "whole", "rest", "alike"))
    own = F.when(size == 0, 1).otherwise(F.floor(full / alike) + (F.col(nth) <= full % alike).cast("long"))
    part = ((rest > 0) & (F.col(nth) == full % alike + 1)).cast("long")
    rows = rows.withColumn(f"{nth}_own", own).filter((own + part) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), own + part)))
    piece = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), rest.cast("int")), "")
    text = F.when(F.col(copy) > F.col(f"{nth}_own"), piece).otherwise(F.col("text"))
    return rows.select(*((text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in columns))
