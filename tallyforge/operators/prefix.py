"""Parallel prefixes: what a row takes from all rows before it, without one task for a long part.

An associative join of row values is folded inside blocks of 64 rows, the blocks' results are folded in blocks of 64, and
so on; what stands before a block is handed down again. A part of n rows takes log64(n) levels and no task sees more than
64 rows of a block together. Finite-state machines are such a join: of their transition functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.staging import shared_folder, staged

BLOCK = 64
#: Ranges of keys for numbering hold about so many rows.
RANGE = 20_000

Join = Callable[[Column, Column], Column]


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def scan(rows: DataFrame, part: list[str], place: str, value: Column, unit: Column, join: Join, name: str, last: int | None = None) -> DataFrame:
    """``rows`` with ``name``: (before, after), the join of the values of all rows of its part before it, and with its own.

    ``place`` numbers the rows of a part from 0 without gaps (gaps only cost); rows of equal place have no defined order.
    ``unit`` is what stands before the first row. ``last``: the largest place, if known; else it is looked up. Rows have no
    columns of maps, which have no order.
    """
    if last is None:
        last = rows.agg(F.max(place)).first()[0] or 0
    kind = rows.select(unit.alias("u")).schema["u"].dataType
    one = rows.select(*part, F.col(place).cast("long").alias("__place"), value.cast(kind).alias("__v"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("__row"))

    def up(level: DataFrame) -> DataFrame:
        """Blocks of a level: (part, place of the block, its values in order)."""
        items = F.array_sort(F.collect_list(F.struct("__place", *(c for c in level.columns if c not in (*part, "__place")))))
        return level.groupBy(*part, F.floor(F.col("__place") / BLOCK).alias("__block")).agg(items.alias("__items"))

    # the rows are read once for all levels and go with their values, so that nothing is joined to them; what is above the
    # first level is small
    levels, n = [staged(up(one), shared_folder(rows.sparkSession), "blocks")], last // BLOCK
    whole = F.aggregate("__items", unit, lambda a, x: join(a, x["__v"]))
    while n:
        levels.append(up(levels[-1].select(*part, F.col("__block").alias("__place"), whole.alias("__v"))))
        n //= BLOCK

    def befores(items: Column, entry: Column) -> Column:
        """What stands before each item, and before the one after the last."""
        start = F.array(entry.cast(kind))
        return F.aggregate(items, start, lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x["__v"]))))

    entries = levels.pop().withColumn("__entry", unit)
    while levels:
        told = entries.withColumn("__out", befores(F.col("__items"), F.col("__entry")))
        each = F.explode(F.transform("__items", lambda x, i: F.struct(x["__place"].alias("at"), F.get("__out", i).alias("before")))).alias("__e")
        told = told.select(*part, each).select(*part, F.col("__e.at").alias("__block"), F.col("__e.before").alias("__entry"))
        below = levels.pop()
        entries = below.join(told, _same(below, told, [*part, "__block"])).select(below["*"], told["__entry"])
    told = entries.withColumn("__out", befores(F.col("__items"), F.col("__entry")))
    both = lambda i: F.struct(F.get("__out", i).alias("before"), F.get("__out", i + 1).alias("after"))
    each = F.explode(F.transform("__items", lambda x, i: F.struct(x["__row"].alias("row"), F.when(x["__place"].isNotNull(), both(i)).alias("found")))).alias("__e")
    return told.select(each).select("__e.row.*", F.col("__e.found").alias(name))


def carried(rows: DataFrame, part: list[str], place: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last value that is not null up to and with each row."""
    kind = rows.select(value.alias("v")).schema["v"].dataType
    out = scan(rows, part, place, value, F.lit(None).cast(kind), lambda a, b: F.coalesce(b, a), "__carried")
    return out.withColumn(name, F.col("__carried.after")).drop("__carried")


def machine(rows: DataFrame, part: list[str], place: str, symbol: Column, table: list[list[int]], name: str = "state", start: int = 0, carry: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the states before and after each row of a machine that starts anew in each part. ``table`` has a row
    for each symbol and in it the next state for each state; a null symbol changes nothing. ``carry``: columns to be added
    in the same pass, the last values that are not null up to and with each row."""
    n, carry = len(table[0]), carry or {}
    stay = F.array(*(F.lit(s) for s in range(n)))
    step = F.coalesce(F.get(F.array(*(F.array(*(F.lit(s) for s in row)) for row in table)), symbol), stay)
    kinds = rows.select(*(c.alias(k) for k, c in carry.items())).schema
    value = F.struct(step.alias("f"), *(c.alias(k) for k, c in carry.items()))
    unit = F.struct(stay.alias("f"), *(F.lit(None).cast(kinds[k].dataType).alias(k) for k in carry))
    join = lambda a, b: F.struct(F.transform(a["f"], lambda s: F.get(b["f"], s)).alias("f"), *(F.coalesce(b[k], a[k]).alias(k) for k in carry))
    out = scan(rows, part, place, value, unit, join, "__functions")
    states = F.struct(F.get("__functions.before.f", F.lit(start)).alias("before"), F.get("__functions.after.f", F.lit(start)).alias("after"))
    return out.select(*rows.columns, states.alias(name), *(F.col(f"__functions.after.{k}").alias(k) for k in carry))


def numbered(rows: DataFrame, part: list[str], key: str, name: str = "place", rows_per_range: int = RANGE) -> DataFrame:
    """``rows`` numbered from 0 inside each part by a numeric ``key``. Keys are cut at approximate quantiles into ranges that
    are counted first, so a part of any size is numbered by many tasks; rows of equal keys are numbered in any order, nulls
    come first."""
    n = max(1, -(-rows.count() // rows_per_range))
    cuts = sorted(set(rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    edges = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    dealt = rows.withColumn("__range", F.coalesce(F.size(F.filter(edges, lambda x: x < F.col(key))), F.lit(0)))
    counts = dealt.groupBy(*part, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select(*part, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*part, "__range").orderBy(F.asc_nulls_first(key)))
    dealt = dealt.withColumn("__inside", inside)
    return dealt.join(starts, _same(dealt, starts, [*part, "__range"])).select(*(dealt[c] for c in rows.columns), (F.col("__start") + F.col("__inside") - 1).alias(name))


def packed(rows: DataFrame, part: list[str], key: str, size: str, most_rows: int, most_size: int, name: str = "batch", rows_per_range: int = RANGE) -> DataFrame:
    """``rows`` with the number of their batch: consecutive rows of a part by ``key``, greedily, at most ``most_rows`` and
    ``most_size`` together; a row that is larger by itself stands alone. Null sizes count 0.

    Where a batch that began at a row would end is looked up among the next rows; which rows do begin one is a machine
    whose state is how many rows of the current batch are still to come.
    """
    folder = shared_folder(rows.sparkSession)
    placed = staged(numbered(rows, part, key, "__place", rows_per_range), folder, "placed")
    span = max(RANGE, most_rows)
    home = F.floor(F.col("__place") / span)
    # the first rows of a range are also seen by the range before, where batches may end in them
    seen = F.when((F.col("__place") % span < most_rows) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    sizes = placed.select(*part, "__place", F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("__s"), home.alias("__home"), F.explode(seen).alias("__seen"))
    ahead = F.collect_list("__s").over(Window.partitionBy(*part, "__seen").orderBy("__place").rowsBetween(Window.currentRow, most_rows - 1))
    fits = F.aggregate("__ahead", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, s: F.struct((a["sum"] + s).alias("sum"), F.when(a["open"] & (a["sum"] + s <= most_size), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["open"] & (a["sum"] + s <= most_size)).alias("open")))
    length = F.greatest(F.lit(1), fits["n"])
    ends = sizes.withColumn("__ahead", ahead).filter("__home = __seen").select(*part, "__place", length.alias("__length"))
    states = [[(k if s == 0 else s - 1) for s in range(most_rows)] for k in range(most_rows)]
    stepped = staged(machine(staged(ends, folder, "ends"), part, "__place", F.col("__length") - 1, states, "__left"), folder, "stepped")
    first = (F.col("__left.before") == 0).cast("long")
    counted = scan(stepped, part, "__place", first, F.lit(0).cast("long"), lambda a, b: a + b, "__count")
    counted = counted.select(*part, "__place", (F.col("__count.after") - 1).alias(name))
    return placed.join(counted, _same(placed, counted, [*part, "__place"])).select(*(placed[c] for c in rows.columns), counted[name])
