"""A kept vector index: lists of vectors around centroids, packed into blocks; exact search by bounds; sync from a change feed.

Files below the index's folder: ``centroids``; ``blocks/version=v``, rows of up to ``BLOCK`` vectors of one list;
``dead/version=v``, places in older blocks whose vectors a version replaced or removed; ``state/version=v``, written last,
so that readers see a version whole or not at all. Only a bounded sample and the centroids reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import changes
from tallyforge.operators.retrieval import ranked
from tallyforge.staging import shared_folder, staged

#: Vectors in a block at most, queries that meet a block at once, vectors that the centroids are fitted on, and rounds.
BLOCK, TOGETHER, SAMPLE, ROUNDS = 1024, 256, 8192, 10
#: Blocks, and packs of queries, of a cell, about: what one task holds of a list.
CELL = 64


@dataclass(frozen=True)
class VectorIndex:
    folder: str
    key: str
    vector: str
    key_type: str


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key whose vectors have a direction: not null, no null or non-finite component, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest magnitudes below 1: no square under- or overflows, no cosine changes."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from the first rows; a centroid that loses all its vectors stays where it was."""
    unit = _unit(sample)
    c = unit[:lists].copy()
    for _ in range(ROUNDS):
        near = (unit @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, unit)
        full = np.abs(sums).max(axis=1) > 1e-12
        c[full] = _unit(sums[full])
    return c


def _packed(rows: DataFrame, key_type: str, most: int, prefix: str) -> DataFrame:
    """(list, block, keys, vectors, n, least): rows of (list, key, vector, near) packed by lists, up to ``most`` in a row; vectors as
    the bytes of a float64 matrix. A hot list is dealt over tasks."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, "list", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("list")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for number, part in batch.groupby("list", sort=True):
                for at in range(0, len(part), most):
                    cut = part.iloc[at : at + most]
                    matrix = _scaled(np.stack(cut["vector"].to_numpy()).astype(np.float64))
                    yield pd.DataFrame({"list": [number], "block": [f"{prefix}-{task}-{nth}"], "keys": [cut["key"].to_numpy()], "vectors": [matrix.tobytes()], "n": [len(cut)], "least": [float(cut["near"].min())]})
                    nth += 1

    return dealt.mapInPandas(pack, f"list int, block string, keys array<{key_type}>, vectors binary, n int, least double")


def _assigned(vectors: DataFrame, key: str, vector: str, key_type: str, centroids: np.ndarray) -> DataFrame:
    """(list, key, vector, near): the list whose centroid is nearest and the cosine to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sims = _unit(np.stack(batch["vector"].to_numpy()).astype(np.float64)) @ centroids.T
                near = sims.argmax(axis=1)
                yield pd.DataFrame({"list": near.astype(np.int32), "key": batch["key"], "vector": batch["vector"], "near": sims[np.arange(len(near)), near]})

    rows = usable(vectors, key, vector).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInPandas(assign, f"list int, key {key_type}, vector array<double>, near double")


def built(vectors: DataFrame, key: str, vector: str, folder: str, lists: int = 64, version: int = 0) -> VectorIndex:
    """An index of all rows with a direction (the others have no cosine), keys unique. The centroids are fitted on at most
    ``SAMPLE`` vectors, drawn by the hash of their keys; fewer vectors than ``lists`` make fewer lists."""
    sample = usable(vectors, key, vector).select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(SAMPLE).select("v").toPandas()["v"]
    spark, index = vectors.sparkSession, VectorIndex(folder, key, vector, vectors.schema[key].dataType.simpleString())
    c = _centroids(np.stack(sample.to_numpy()), lists) if len(sample) else np.zeros((0, 0))
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(c)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    spark.createDataFrame([], "block string, places array<int>").write.parquet(f"{folder}/dead/version={version}")
    _add(index, vectors, c, version)
    return index


def _read(spark: SparkSession, index: VectorIndex) -> np.ndarray:
    rows = spark.read.parquet(f"{index.folder}/centroids").orderBy("list").collect()  # a row a list
    return np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))


def _add(index: VectorIndex, vectors: DataFrame, centroids: np.ndarray, version: int) -> None:
    spark = vectors.sparkSession
    if not len(centroids):  # an index that was built of nothing takes one direction as its only list
        one = usable(vectors, index.key, index.vector).select(F.col(index.vector).cast("array<double>").alias("v")).limit(1).collect()
        centroids = _unit(np.array([one[0].v])) if one else centroids
        if one:
            spark.createDataFrame([(0, centroids[0].tolist())], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.folder}/centroids")
    rows = _assigned(vectors, index.key, index.vector, index.key_type, centroids) if len(centroids) else vectors.sparkSession.createDataFrame([], f"list int, key {index.key_type}, vector array<double>, near double")
    _packed(rows, index.key_type, BLOCK, str(version)).write.mode("overwrite").parquet(f"{index.folder}/blocks/version={version}")
    spark.range(1).select(F.lit(version).alias("v")).write.mode("overwrite").parquet(f"{index.folder}/state/version={version}")


def synced(spark: SparkSession, index: VectorIndex) -> int:
    """The newest version that is wholly in the index."""
    return spark.read.schema("v int, version int").parquet(f"{index.folder}/state").agg(F.max("version")).first()[0]


def _versions(spark: SparkSession, index: VectorIndex, what: str, schema: str, upto: int) -> DataFrame:
    return spark.read.schema(f"{schema}, version int").parquet(f"{index.folder}/{what}").filter(F.col("version") <= upto)


def _blocks(spark: SparkSession, index: VectorIndex, upto: int) -> DataFrame:
    """Blocks with the places in them that later versions took away."""
    rows = _versions(spark, index, "blocks", f"list int, block string, keys array<{index.key_type}>, vectors binary, n int, least double", upto)
    dead = _versions(spark, index, "dead", "block string, places array<int>", upto).groupBy("block").agg(F.flatten(F.collect_list("places")).alias("places"))  # a block's places at most
    return rows.join(dead, "block", "left")


def sync(spark: SparkSession, index: VectorIndex, feed: DataFrame) -> int:
    """Apply the versions of a change feed that the index lacks, their net changes as one version; the version it has then.
    A call that dies leaves the index at its old version, and the next one writes the same files again."""
    have = synced(spark, index)
    upto = feed.agg(F.max("version")).first()[0]
    if upto is None or upto <= have:
        return have
    net = changes.between(feed.select(index.key, index.vector, "change", "changed", "version"), [index.key], have, upto)
    touched = net.filter(F.col("change").isin(changes.DELETE, changes.BEFORE)).select(F.col(index.key).alias("key"))
    rows = _blocks(spark, index, have).select("block", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.posexplode("keys").alias("place", "key"))
    gone = rows.filter(~F.array_contains("places", F.col("place"))).join(touched, "key").groupBy("block").agg(F.collect_list("place").alias("places"))
    gone.write.mode("overwrite").parquet(f"{index.folder}/dead/version={upto}")
    _add(index, net.filter(F.col("change").isin(changes.INSERT, changes.AFTER)), _read(spark, index), upto)
    return upto


def wait(spark: SparkSession, index: VectorIndex, version: int, seconds: float, pause: float = 1.0) -> int:
    """Return the version once the index has ``version`` or a newer one; TimeoutError if that takes longer than ``seconds``."""
    end = time.monotonic() + seconds
    while (have := synced(spark, index)) < version:
        if time.monotonic() > end:
            raise TimeoutError(f"the index has version {have}, not {version}")
        time.sleep(pause)
    return have


class _Pack:
    """Queries that meet blocks one after the other, with the k best of each so far, ties by key."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, k: int):
        self.vectors, self.norms, self.keys, self.k = vectors, np.sqrt((vectors * vectors).sum(axis=1))[:, None], keys, k
        self.floor = np.full(len(vectors), -np.inf)
        self.line, self.found, self.score = np.zeros(0, int), None, np.zeros(0)

    def meet(self, x: np.ndarray, keys: np.ndarray, places: int) -> None:
        s = np.round((self.vectors @ x.T) / (self.norms * np.sqrt((x * x).sum(axis=1))[None, :]), places)
        if len(keys) > self.k:  # what ties with the last one is compared before it is cut
            self.floor = np.maximum(self.floor, np.partition(s, len(keys) - self.k, axis=1)[:, len(keys) - self.k])
        line, at = np.nonzero(s >= self.floor[:, None])
        line, score = np.concatenate([self.line, line]), np.concatenate([self.score, s[line, at]])
        found = keys[at] if self.found is None else np.concatenate([self.found, keys[at]])
        order = np.lexsort((found, -score, line))
        line = line[order]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        order = order[rank < self.k]
        self.line, self.found, self.score = line[rank < self.k], found[order], score[order]
        last = rank == self.k - 1
        self.floor[line[last]] = self.score[np.flatnonzero(last[rank < self.k])]


def _scored(blocks: DataFrame, packs: DataFrame, index: VectorIndex, query_key: str, query_type: str, k: int, places: int, groups: tuple[int, int]) -> DataFrame:
    """(query, key, score): each query's k best of each cell, as products of small matrices.

    A list's blocks and packs of queries are dealt to ``groups``, and each pair of groups is a cell. A task holds a cell's packs and
    reads its blocks one by one, so what it holds and what it passes on doesn't grow with the table.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told() -> Iterator[pd.DataFrame]:
            for p in held:
                if len(p.line):
                    yield pd.DataFrame({query_key: p.keys[p.line], "key": p.found, "score": p.score})

        cell, held = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.list, row.g, row.h) != cell:
                    yield from told()
                    cell, held = (row.list, row.g, row.h), []
                x = np.frombuffer(row.vectors).reshape(row.n, -1)
                if not row.block:
                    held.append(_Pack(x, np.asarray(row.q_keys), k))
                    continue
                keys = np.asarray(row.keys)
                if row.places is not None and len(row.places):
                    alive = np.ones(row.n, bool)
                    alive[np.asarray(row.places)] = False
                    x, keys = x[alive], keys[alive]
                if len(keys):
                    for p in held:
                        p.meet(x, keys, places)
        yield from told()

    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    of_blocks, of_packs = groups
    a = blocks.select("list", own(of_blocks).alias("g"), every(of_packs).alias("h"), F.lit(True).alias("block"), "keys", none(f"array<{query_type}>").alias("q_keys"), "vectors", "n", "places")
    b = packs.select("list", every(of_blocks).alias("g"), own(of_packs).alias("h"), F.lit(False).alias("block"), none(f"array<{index.key_type}>").alias("keys"), F.col("keys").alias("q_keys"), "vectors", "n", none("array<int>").alias("places"))
    rows = a.unionByName(b).repartition("list", "g", "h").sortWithinPartitions("list", "g", "h", "block")
    # Arrow batches end at spark.sql.execution.arrow.maxBytesPerBatch (64 MB)
    return rows.mapInPandas(score, f"{query_key} {query_type}, key {index.key_type}, score double")


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, query_key: str, query_vector: str, k: int, probes: int = 8, exact: bool = True, itself: bool = True, places: int = 9) -> DataFrame:
    """(query, key, score, rank): the k nearest by cosine, rounded, ties by key; without ``itself`` a query's own key is left out.

    Every query meets the vectors of its ``probes`` nearest lists. With ``exact`` it then meets each other list that could
    hold something as near as its k-th hit: no vector of a list is nearer than the angle to the centroid less the list's
    widest angle. Without it the answer is approximate. Queries without a direction have no hits.
    """
    upto, c = synced(spark, index), _read(spark, index)
    query_type = queries.schema[query_key].dataType.simpleString()
    asked = usable(queries, query_key, query_vector).select(F.col(query_key).alias("key"), F.col(query_vector).cast("array<double>").alias("vector"))
    blocks = _blocks(spark, index, upto)
    # the lists' widest angles and sizes: a row a list
    lists = blocks.groupBy("list").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("blocks")).collect()
    wide = {r.list: np.arccos(min(1.0, r.least)) for r in lists}
    # a list's queries are packed in at most 16 tasks, each of which may leave one pack that is not full
    groups = -(-max((r.blocks for r in lists), default=1) // CELL), -(-(asked.count() // TOGETHER + 16) // CELL)
    radius = np.array([wide.get(i, 0.0) for i in range(len(c))])
    most = k if itself else k + 1

    def lists_of(batches: Iterator[pd.DataFrame], second: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(c):
                continue
            sims = np.clip(_unit(np.stack(batch["vector"].to_numpy()).astype(np.float64)) @ c.T, -1, 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            chosen = np.zeros(sims.shape, bool)
            np.put_along_axis(chosen, order[:, :probes], True, axis=1)
            if second:
                nearest = np.cos(np.maximum(0.0, np.arccos(sims) - radius))
                floor = batch["floor"].to_numpy(dtype=np.float64, na_value=-2.0) - 10.0 ** -min(places, 9)
                chosen = ~chosen & (nearest >= floor[:, None])
            at, number = np.nonzero(chosen)
            yield pd.DataFrame({"list": number.astype(np.int32), "key": batch["key"].to_numpy()[at], "vector": batch["vector"].to_numpy()[at], "near": 1.0})

    made = f"list int, key {query_type}, vector array<double>, near double"
    scored = lambda rows: _scored(blocks, _packed(rows, query_type, TOGETHER, "q"), index, query_key, query_type, most, places, groups)
    hits = scored(asked.mapInPandas(lambda b: lists_of(b, False), made))
    if exact and len(c) > probes:
        hits = staged(hits, shared_folder(spark), "hits")  # read twice: for the bounds and for the answer
        last = ranked(hits, query_key, "key", most).filter(F.col("rank") == most).select(F.col(query_key).alias("key"), F.col("score").alias("floor"))
        hits = hits.unionByName(scored(asked.join(last, "key", "left").mapInPandas(lambda b: lists_of(b, True), made)))
    if not itself:
        hits = hits.filter(F.col("key") != F.col(query_key))
    return ranked(hits, query_key, "key", k).withColumnRenamed("key", index.key)
