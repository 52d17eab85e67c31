"""Table contracts: ordered typed columns with roles and vocabularies, a natural key, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import record_key

#: Roles whose columns describe a row's origin, not its content.
OUTSIDE_HASH = ("INTEGRITY", "OPERATIONAL")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    role: str = "DATA"
    vocabulary: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    table: str
    key: tuple[str, ...]
    columns: tuple[ColumnSpec, ...] = field(default_factory=tuple)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type), c.nullable, {"role": c.role, "vocabulary": list(c.vocabulary)}) for c in self.columns])

    def content(self) -> list[str]:
        return sorted(c.name for c in self.columns if c.role not in OUTSIDE_HASH)

    def content_hash(self) -> Column:
        """SHA-256 of the content columns as JSON, nulls included, in the order of their names."""
        return F.sha2(F.to_json(F.struct(*self.content()), {"ignoreNullFields": "false"}), 256)

    def finalize(self, df: DataFrame, snapshot: str) -> DataFrame:
        """record_id, the contract's columns cast in order, record_hash and the snapshot."""
        rows = df.select(*(F.col(c.name).cast(c.type).alias(c.name) for c in self.columns))
        return rows.select(record_key(F.lit(self.table), *(F.col(k) for k in self.key)).alias("record_id"), *(c.name for c in self.columns), self.content_hash().alias("record_hash"), F.lit(snapshot).alias("_source_snapshot_id"))

    def violations(self, df: DataFrame) -> DataFrame:
        """(check, n) for nulls, foreign words, repeated keys and hashes that no longer fit, in one aggregation."""
        checks = {f"NULL_{c.name}": F.count_if(F.col(c.name).isNull()) for c in self.columns if not c.nullable}
        checks |= {f"VOCABULARY_{c.name}": F.count_if(F.col(c.name).isNotNull() & ~F.col(c.name).isin(*c.vocabulary)) for c in self.columns if c.vocabulary}
        checks["DUPLICATE_ID"] = F.count(F.lit(1)) - F.count_distinct("record_id")
        checks["HASH_DRIFT"] = F.count_if(F.col("record_hash") != self.content_hash())
        one = df.agg(*(c.alias(n) for n, c in checks.items()))
        return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("n")) for n in checks))))

    def mismatch(self, df: DataFrame) -> list[str]:
        """How a frame's columns differ from the contract; nothing is read."""
        want, have = {c.name: T._parse_datatype_string(c.type).simpleString() for c in self.columns}, dict(df.dtypes)
        return [f"missing {c}" for c in want if c not in have] + [f"{c}: {have[c]} instead of {want[c]}" for c in want if c in have and have[c] != want[c]]
