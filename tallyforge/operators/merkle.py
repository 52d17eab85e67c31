"""Identity of a table as a hash tree over ranges of its keys: the root does not depend on order or partitioning, and two
tables are compared down the tree only where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.staging import shared_folder, staged

#: Children of a node, and levels below the root: 16 ** 3 ranges of keys.
FAN, LEVELS = 16, 3


def _range_of(keys: list[str], level: int) -> Column:
    """The range of a key's hash at a level, as so many hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys)), 256), 1, level)


def _row(columns: list[str]) -> Column:
    """The digest of a row: names and values, null unlike any text."""
    parts = [F.concat(F.lit(f"{c}\x1f"), F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("\x00"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1e", *parts), 256)


def leaves(rows: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """(node, n, digest) for each range of keys that has rows: four sums of 64-bit parts of the rows' digests, so rows are
    combined where they lie and a row that is there twice counts twice."""
    digest = _row(rows.columns)
    word = lambda i: F.conv(F.substring("__d", 16 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    dealt = rows.select(_range_of(keys, levels).alias("node"), digest.alias("__d"))
    sums = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *(F.sum(word(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)))
    return sums.select("node", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.col(f"s{i}").cast("string") for i in range(4))), 256).alias("digest"))


def tree(rows: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """(level, node, n, digest) of all nodes; level 0 is the root, of an empty table too. Above the leaves there are at most
    16 children to a node."""
    level = staged(leaves(rows, keys, levels), shared_folder(rows.sparkSession), "leaves")
    out = level.select(F.lit(levels).alias("level"), "node", "n", "digest")
    for depth in range(levels - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        folded = F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws("|", c["node"], c["digest"])), ";"), 256)
        up = level.select(F.substring("node", 1, depth).alias("up"), "n", "node", "digest")
        level = up.groupBy("up").agg(F.sum("n").alias("n"), folded.alias("digest")) if depth else up.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), folded.alias("digest")).withColumn("up", F.lit(""))
        level = level.select(F.col("up").alias("node"), "n", "digest")
        out = out.unionByName(level.select(F.lit(depth).alias("level"), "node", "n", "digest"))
    return out


def root(rows: DataFrame, keys: list[str], levels: int = LEVELS) -> str:
    """A table's identity."""
    return tree(rows, keys, levels).filter("level = 0").first()["digest"]


def differing_ranges(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(node) of the leaves in which two trees differ, found from the root down: of each level only children of nodes that
    differ are looked at."""
    nodes = None
    for depth in range(levels + 1):
        mine, theirs = (t.filter(F.col("level") == depth).select("node", "digest") for t in (a, b))
        if nodes is not None:
            up = nodes.select(F.col("node").alias("__up"))
            mine, theirs = (t.join(up, F.substring("node", 1, depth - 1) == F.col("__up"), "left_semi") for t in (mine, theirs))
        nodes = mine.join(theirs.withColumnRenamed("digest", "other"), "node", "full").filter(~F.col("digest").eqNullSafe(F.col("other"))).select("node")
    return nodes


def differences(a: DataFrame, b: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """(keys, status) of the rows that are only in ``a`` (MISSING), only in ``b`` (UNEXPECTED) or differ (MISMATCH). Whole rows
    are compared in ranges of keys whose digests differ; keys are unique on each side."""
    folder = shared_folder(a.sparkSession)
    trees = (staged(tree(t, keys, levels), folder, "tree") for t in (a, b))
    ranges = staged(differing_ranges(*trees, levels), folder, "ranges")

    def within(t: DataFrame, side: str) -> DataFrame:
        kept = t.withColumn("__node", _range_of(keys, levels)).join(ranges.withColumnRenamed("node", "__node"), "__node", "left_semi")
        return kept.select(*keys, _row(t.columns).alias(side))

    both = within(a, "__a").join(within(b, "__b"), keys, "full")
    status = F.when(F.col("__b").isNull(), "MISSING").when(F.col("__a").isNull(), "UNEXPECTED").when(F.col("__a") != F.col("__b"), "MISMATCH")
    return both.select(*keys, status.alias("status")).filter("status is not null")
