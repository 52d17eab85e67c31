"""Snapshot merge and versions without a table format: a version is a folder, the manifest names the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import fingerprint


def merge_plan(current: DataFrame, incoming: DataFrame, key: str = "record_id", digest: str = "record_hash") -> DataFrame:
    """(key, action): INSERT, UPDATE, DELETE or KEEP for every key of either side; one full join on the key."""
    a, b = current.select(F.col(key).alias("__a"), F.col(digest).alias("__ha")), incoming.select(F.col(key).alias("__b"), F.col(digest).alias("__hb"))
    action = F.when(F.col("__a").isNull(), "INSERT").when(F.col("__b").isNull(), "DELETE").when(F.col("__ha").eqNullSafe(F.col("__hb")), "KEEP").otherwise("UPDATE")
    return a.join(b, F.col("__a") == F.col("__b"), "full").select(F.coalesce("__a", "__b").alias(key), action.alias("action"))


def merged(current: DataFrame, incoming: DataFrame, key: str = "record_id", digest: str = "record_hash") -> DataFrame:
    """The table after the merge; kept rows keep what was loaded with them."""
    same = incoming.select(F.col(key).alias("__k"), F.col(digest).alias("__h"))
    on = (F.col(key) == F.col("__k")) & F.col(digest).eqNullSafe(F.col("__h"))
    kept = current.join(same, on, "left_semi")
    held = current.select(F.col(key).alias("__k"), F.col(digest).alias("__h"))
    return kept.unionByName(incoming.join(held, on, "left_anti"))


def missing_only(cache: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What an insert-only cache lacks."""
    return incoming.join(cache.select(*keys), keys, "left_anti").dropDuplicates(keys)


class VersionedTable:
    """A table of Parquet versions under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(conf)

    def history(self) -> list[dict]:
        """Versions, oldest first: number, folder, counts of actions."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest")
        if not fs.exists(folder):
            return []
        return sorted((json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/_manifest/*.json", wholetext=True).collect()), key=lambda v: v["version"])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, or the latest."""
        versions = {v["version"]: v["folder"] for v in self.history()}
        if not versions:
            raise FileNotFoundError(f"no version under {self.path}")
        return self.spark.read.parquet(f"{self.path}/{versions[max(versions) if version is None else version]}")

    def write_snapshot(self, incoming: DataFrame, key: str = "record_id", digest: str = "record_hash") -> dict:
        """Merge a whole snapshot and publish it as the next version; a snapshot without changes publishes nothing."""
        versions = self.history()
        counts = {"INSERT": 0, "UPDATE": 0, "DELETE": 0, "KEEP": 0}
        if versions:
            current = self.read()
            counts |= {r["action"]: r["count"] for r in merge_plan(current, incoming, key, digest).groupBy("action").count().collect()}
            if not counts["INSERT"] + counts["UPDATE"] + counts["DELETE"]:
                return versions[-1] | {"counts": counts}
            rows = merged(current, incoming, key, digest)
        else:
            rows, counts["INSERT"] = incoming, incoming.count()
        number = versions[-1]["version"] + 1 if versions else 1
        entry = {"version": number, "folder": f"v{number}-{uuid.uuid4().hex[:8]}", "counts": counts}
        rows.write.parquet(f"{self.path}/{entry['folder']}")
        jvm, fs = self._fs()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{number:09d}.json"), False)  # fails if another writer was first
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return entry

    def verify(self, df: DataFrame) -> bool:
        """Whether the published rows are those of ``df``, in any order."""
        mine = self.read().select(*df.columns)
        return fingerprint(mine, df.columns).first() == fingerprint(df, df.columns).first()
