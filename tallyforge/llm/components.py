"""Connected components of an edge list that may be larger than any one machine, and forests of small dense groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_ROUNDS = 60


def _toward_minimum(edges: DataFrame, keep_own: bool) -> DataFrame:
    """Each (u, v) points v at the least of u's neighbours; with ``keep_own`` u itself counts and only larger v move."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if keep_own:
        least = least.select("u", F.least("u", "m").alias("m"))
        return edges.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long src, long dst); root is the least node of its component.

    Alternating large-star and small-star steps: every step replaces edges by as many or fewer that point at smaller
    nodes, until all are stars. Minima are combined before shuffling and the joins are splittable on hot hubs. Each
    round is written to the shared folder, so lineage stays short. Self-loops, repeated and null edges have no effect
    beyond their nodes; no edges give no rows.
    """
    pairs = edges.filter("src is not null and dst is not null and src != dst")
    now = stage(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    print_of = F.expr("struct(count(*), bit_xor(xxhash64(u, v)))")
    before = now.agg(print_of.alias("p")).first()[0]
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both, True).distinct()
        now = stage(_toward_minimum(large, False).distinct(), "edges")
        after = now.agg(print_of.alias("p")).first()[0]
        if after == before:
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


class Forest:
    """Union-find over 0..n-1 that takes edges in bulk and tells which of them joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        r = self.parent[nodes]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Union all a[i]-b[i]; returns edges that connect the same sets, at most about one for each node a call merges."""
        kept_a, kept_b = [], []
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            first = np.unique(hi, return_index=True)[1]
            self.parent[hi[first]] = lo[first]
            kept_a.append(a[first])
            kept_b.append(b[first])
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (none, none)
