"""The gate before a table: invariants that stop its write and observations that are only told, each counted in one pass.

A check is a number of each row; what a row must know of other tables (whether its source exists, what the source says) is
joined to it first, so that all checks of a table are sums over one frame. The same sums are observed in the job that
writes the rows, so nothing is read twice to be checked.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
#: Places of an order that one task compares.
SPAN = 20_000


@dataclass(frozen=True)
class Check:
    """``n`` of a row, a condition or a number, is summed over the rows; null adds nothing."""

    check_id: str
    severity: str
    n: Column


@dataclass(frozen=True)
class Gate:
    """A table's rows with what they must know, its checks, and which columns of which rows are to be written (none: the
    rows are only counted)."""

    rows: DataFrame
    checks: tuple[Check, ...]
    columns: tuple[str, ...] = ()
    kept: Column | None = None


class GateClosed(RuntimeError):
    """An invariant failed; ``counts`` says which and how often."""

    def __init__(self, table: str, counts: dict[str, int]):
        super().__init__(f"{table}: " + ", ".join(f"{k} {n}" for k, n in sorted(counts.items())))
        self.table, self.counts = table, counts


def _sums(checks: tuple[Check, ...]) -> list[Column]:
    return [F.coalesce(F.sum(c.n.cast("long")), F.lit(0).cast("long")).alias(c.check_id) for c in checks]


def counts(gates: dict[str, list[Gate]]) -> DataFrame:
    """(table_name, check_id, severity, n, status): one aggregation for each frame. The parts of a check that several frames
    of a table count are summed. status is PASS where n is 0, else FAIL for an ERROR and OBSERVED for the others."""
    each = []
    for name, parts in gates.items():
        for g in (g for g in parts if g.checks):
            found = F.array(*(F.struct(F.lit(name).alias("table_name"), F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"), F.col(c.check_id).alias("n")) for c in g.checks))
            each.append(g.rows.agg(*_sums(g.checks)).select(F.inline(found)))
    one = reduce(DataFrame.unionByName, each).groupBy("table_name", "check_id", "severity").agg(F.sum("n").alias("n"))
    return one.withColumn("status", F.when(F.col("n") == 0, "PASS").when(F.col("severity") == ERROR, "FAIL").otherwise("OBSERVED"))


def written(table: str, parts: list[Gate], folder: str) -> DataFrame:
    """The rows of the one part that has columns, written below ``folder`` and read again; GateClosed if an ERROR was counted.

    Parts without columns are counted first and stop the write before it begins. The others are observed by the job that
    writes: its files stand under a name that nobody is told when the gate is closed. Called again after a failure it
    writes under a new name.
    """
    (main,) = (g for g in parts if g.columns)
    if others := [g for g in parts if not g.columns]:
        failed = counts({table: others}).filter("status = 'FAIL'").collect()  # a row a check at most
        if failed:
            raise GateClosed(table, {r.check_id: r.n for r in failed})
    seen = Observation(f"{table}-{uuid.uuid4().hex[:8]}")
    rows = main.rows.observe(seen, F.count(F.lit(1)).alias("__rows"), *_sums(main.checks))
    rows = (rows if main.kept is None else rows.filter(main.kept)).select(*main.columns)
    path = f"{folder}/{table}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(path)
    got = seen.get
    failed = {c.check_id: got[c.check_id] for c in main.checks if c.severity == ERROR and got.get(c.check_id)}
    if failed:
        raise GateClosed(table, failed)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def resolved(rows: DataFrame, on: dict[str, str], known: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether the values of its columns (the keys of ``on``) stand together in the columns of
    ``known`` (its values). A null value is never resolved; known values may repeat."""
    keys = known.select(*(F.col(v).alias(f"__known_{i}") for i, v in enumerate(on.values()))).dropna().distinct().withColumn(flag, F.lit(True))
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__known_{i}") for i, k in enumerate(on)))
    joined = rows.join(keys, same, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return joined.drop(*(f"__known_{i}" for i in range(len(on))))


def covered(rows: DataFrame, key: str, expected: DataFrame, expected_key: str) -> DataFrame:
    """(key, here, there): how many rows of each side have a key, null being a key like others; aggregated before it is
    shuffled, so that a hot key costs nothing. ``uncovered`` counts what is wrong of a row."""
    side = lambda df, k, here, there: df.select(F.col(k).alias("key"), F.lit(here).alias("a"), F.lit(there).alias("b"))
    both = side(rows, key, 1, 0).unionByName(side(expected, expected_key, 0, 1))
    return both.groupBy("key").agg(F.sum("a").alias("here"), F.sum("b").alias("there"))


def uncovered() -> Column:
    """1 for a key that one side lacks, and 1 for each row too many here."""
    return F.when(F.col("here") == 0, 1).otherwise(F.col("here") - 1 + F.when(F.col("there") == 0, 1).otherwise(0))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each key with ``extra``, the rows it has beyond one."""
    return rows.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))


def before(rows: DataFrame, group: str, place: str, value: str, name: str) -> DataFrame:
    """``rows`` with the value of the row before it in its group by ``place`` (a number, unique in the group), null for the
    first. Places are cut into spans of ``SPAN``; a span's first row takes the last value of the span before it that has
    rows, so that a hot group is sorted by many tasks. Rows of the null group count as one group."""
    cut = rows.withColumn("__span", F.floor(F.col(place) / SPAN))
    inside = Window.partitionBy(group, "__span").orderBy(place)
    ends = cut.groupBy(group, "__span").agg(F.max_by(value, place).alias("__end"))
    order = Window.partitionBy(group).orderBy("__span")  # a row a span
    ends = ends.select(F.col(group).alias("__g"), F.col("__span").alias("__s"), F.lag("__end").over(order).alias("__end"))
    joined = cut.join(ends, cut[group].eqNullSafe(ends["__g"]) & (cut["__span"] == ends["__s"]), "left")
    first = F.row_number().over(inside) == 1
    return joined.withColumn(name, F.when(first, F.col("__end")).otherwise(F.lag(value).over(inside))).drop("__g", "__s", "__end", "__span")
