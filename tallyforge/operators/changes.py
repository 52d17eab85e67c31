"""Change feeds: what differs between two states of a table, column by column, and what a reader of several versions has
to replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"


def differing(before: DataFrame, after: DataFrame, columns: list[str], a: str = "__a", b: str = "__b") -> Column:
    """The names of the columns whose values differ, nulls being equal to each other only."""
    return F.array_compact(F.array(*(F.when(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), c) for c in columns)))


def changes(before: DataFrame, after: DataFrame, keys: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``after`` or ``before`` with (change, changed): inserts, deletes, and both images of each update, with the
    names of the columns that differ. Columns that are ``ignored`` (when and by whom a row was loaded) are carried but
    make no change. Keys are unique on each side and not null; both sides have the same columns."""
    columns = before.columns
    compared = [c for c in columns if c not in keys and c not in ignored]
    a = before.select(*(F.col(k).alias(f"__ka_{k}") for k in keys), F.struct(*columns).alias("__a"))
    b = after.select(*(F.col(k).alias(f"__kb_{k}") for k in keys), F.struct(*columns).alias("__b"))
    both = a.join(b, reduce(lambda x, y: x & y, (F.col(f"__ka_{k}") == F.col(f"__kb_{k}") for k in keys)), "full")
    changed = differing(before, after, compared)
    is_new, is_gone = F.col("__a").isNull(), F.col("__b").isNull()
    none = F.array().cast("array<string>")
    one = lambda kind, row, names: F.struct(F.lit(kind).alias("change"), row.alias("row"), names.alias("changed"))
    rows = F.when(is_new, F.array(one(INSERT, F.col("__b"), none))).when(is_gone, F.array(one(DELETE, F.col("__a"), none)))
    rows = rows.when(F.size(changed) > 0, F.array(one(BEFORE, F.col("__a"), changed), one(AFTER, F.col("__b"), changed)))
    return both.select(F.inline(rows)).select("row.*", "change", "changed")


def record(found: DataFrame, feed: str, version: int) -> None:
    """Add a version's changes to a feed; a version is written once, and a run that dies leaves none of it to be read."""
    found.write.parquet(f"{feed}/version={version}")


def between(feed: DataFrame, keys: list[str], after: int, upto: int, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The net changes of the versions ``after`` < version <= ``upto`` of a feed: what was inserted and deleted again, or
    changed and changed back, is left out; of several updates the first image and the last one count."""
    columns = [c for c in feed.columns if c not in ("change", "changed", "version")]
    rows = feed.filter((F.col("version") > after) & (F.col("version") <= upto))
    had = F.col("change").isin(DELETE, BEFORE)
    # of a version that has both images the older one stands first
    at = F.struct("version", (~had).cast("int").alias("nth"))
    image = F.struct(*columns)
    per = rows.groupBy(*(F.col(k).alias(f"__k_{k}") for k in keys)).agg(
        F.min_by(F.struct(had.alias("is"), image.alias("row")), at).alias("first"), F.max_by(F.struct((~had).alias("is"), image.alias("row")), at).alias("last")
    )
    per = per.select(F.when(F.col("first.is"), F.col("first.row")).alias("__a"), F.when(F.col("last.is"), F.col("last.row")).alias("__b"))
    compared = [c for c in columns if c not in keys and c not in ignored]
    changed = differing(feed, feed, compared)
    none = F.array().cast("array<string>")
    one = lambda kind, row, names: F.struct(F.lit(kind).alias("change"), row.alias("row"), names.alias("changed"))
    is_new, is_gone = F.col("__a").isNull(), F.col("__b").isNull()
    net = F.when(is_new & is_gone, F.array().cast(f"array<struct<change:string,row:{feed.select(image.alias('r')).schema['r'].dataType.simpleString()},changed:array<string>>>"))
    net = net.when(is_new, F.array(one(INSERT, F.col("__b"), none))).when(is_gone, F.array(one(DELETE, F.col("__a"), none)))
    net = net.when(F.size(changed) > 0, F.array(one(BEFORE, F.col("__a"), changed), one(AFTER, F.col("__b"), changed)))
    return per.select(F.inline(net)).select("row.*", "change", "changed")
