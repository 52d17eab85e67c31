"""Helpers that the operators of this subpackage share: staging, let-binding, words, groups of sorted batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The shared folder for staged tables: below spark.checkpoint.dir; where that is unset, the warehouse on a
    cluster, which must then not be a machine's own folder, and a temporary folder in local mode. It is removed when the
    application ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            local = spark.sparkContext.master.split("[")[0] == "local"
            base = "file://" + tempfile.mkdtemp(prefix="tallyforge-") if local else spark.conf.get("spark.sql.warehouse.dir")
            if not local and base.split(":")[0] in ("file", base):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(base)
        _folders[app] = f"{base.rstrip('/')}/staged-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # stopped: the JVM is gone, a local folder can still be removed
        if folder.startswith("file:"):
            shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    elif not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{label}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running fold of an array by an associative function, in log2(n) passes over it: no array grows step by step."""

    def doubled(now: Column, step: Column) -> Column:
        return F.transform(now, lambda x, i: F.when(i >= step, combine(F.get(now, i - step), x)).otherwise(x))

    last = F.greatest(F.size(values) - 1, F.lit(1))
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(last)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, doubled))


def bounded_sample(rows: DataFrame, n: int, draw: str, bound: int) -> DataFrame:
    """At most ``bound`` of ``n`` rows, those with the least value of the hash column ``draw``. Only rows whose hash lies
    in the share that is expected to hold them are sorted, so what reaches the driver doesn't grow with the tasks."""
    share = min(1.0, (1.2 * bound + 100) / max(1, n))
    uniform = F.shiftrightunsigned(draw, 11).cast("double") / F.lit(float(1 << 53))
    return rows.filter(uniform < share).orderBy(draw, *(c for c in rows.columns if c != draw)).limit(bound)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with equal keys out of batches that are sorted by them; a run may cross batches."""
    carried: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys]
        starts = (k != k.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        bounds = [*starts, len(batch)]
        values = list(k.iloc[starts].itertuples(index=False, name=None))
        for i, key in enumerate(values):
            part = batch.iloc[bounds[i] : bounds[i + 1]]
            if key == last:
                carried.append(part)
                continue
            if carried:
                yield last, carried[0] if len(carried) == 1 else pd.concat(carried, ignore_index=True)
            carried, last = [part], key
    if carried:
        yield last, carried[0] if len(carried) == 1 else pd.concat(carried, ignore_index=True)
