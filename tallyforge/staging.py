"""Tables that are written into the folder which all executors share, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that sorts or gathers by a key, about.
DEALT = 50_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below the warehouse on a cluster, and a temporary one in
    local mode. Whoever runs the application clears what it leaves there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = "file://" + tempfile.mkdtemp(prefix="tallyforge-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/kept-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = DEALT) -> DataFrame:
    """``df`` in tasks by keys, of about ``rows`` rows each. Bytes that are shuffled say little of what rows take in memory, and
    small shuffles are put together into few tasks; a number that is asked for stays."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
