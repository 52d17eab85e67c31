"""Governed reads: a request names a table, its scope, columns, filters and order; a guard refuses foreign rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 2000
_TOO_MANY = f"more than {MOST_ROWS} rows"


class ScopeError(ValueError):
    """A request or a result outside of what may be read."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object = None

    def column_expression(self) -> Column:
        c = F.col(self.column)
        if self.op == "in":
            return c.isin(*self.value)
        return {"eq": lambda: c == F.lit(self.value), "ge": lambda: c >= F.lit(self.value), "le": lambda: c <= F.lit(self.value), "not_null": c.isNotNull}[self.op]()


@dataclass(frozen=True)
class ReadRequest:
    table: str
    scope: object
    columns: tuple[str, ...]
    filters: tuple[Filter, ...] = ()
    order_by: tuple[str, ...] = ()


def read(request: ReadRequest, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The rows of a request as one plan; null never matches a filter, and a result beyond 2,000 rows fails
    wherever it is used, never a silent cut: filters belong into the request, since they can't save it afterwards. ``tables``: frame and scope column of what may be read."""
    if request.table not in tables:
        raise ScopeError(f"{request.table} may not be read")
    df, scope = tables[request.table]
    if unknown := [c for c in (*request.columns, *(f.column for f in request.filters), *(o.lstrip("-") for o in request.order_by)) if c not in df.columns]:
        raise ScopeError(f"{request.table} has no {', '.join(unknown)}")
    if request.scope is None:
        raise ScopeError("a request needs a scope")
    rows = df.where(F.col(scope) == F.lit(request.scope))
    for f in request.filters:
        rows = rows.where(f.column_expression())
    order = [F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in request.order_by]
    rows = rows.orderBy(*order) if order else rows
    # the window has no partition, but the limit has left few rows
    nth = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    held = rows.select(*request.columns).limit(MOST_ROWS + 1).select("*", nth.alias("__nth"))
    fits = F.when(F.col("__nth") <= MOST_ROWS, F.lit(True)).otherwise(F.raise_error(F.lit(_TOO_MANY)).cast("boolean"))
    return held.where(fits).select(*request.columns)


def collected(rows: DataFrame) -> list:
    try:
        found = rows.collect()
    except PySparkException as e:
        if _TOO_MANY in str(e):
            raise ScopeError(_TOO_MANY) from e
        raise
    if len(found) > MOST_ROWS:
        raise ScopeError(_TOO_MANY)
    return found


def guarded(rows: DataFrame, scope: str, value: object) -> DataFrame:
    """``rows``, failing where one is foreign: a filter would hide the defect."""
    ok = F.col(scope).eqNullSafe(F.lit(value))
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"row outside of {scope}={value}")).cast("boolean")))
