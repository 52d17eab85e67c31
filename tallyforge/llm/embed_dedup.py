"""Operator 2: embedding near-dedup over an inverted multi-index.

Independent codebooks for the two halves of the unit vectors span a product grid; a vector lives in the cell of its two
nearest codewords. Two unit vectors with cosine c lie sqrt(2 - 2c) apart, and the hyperplane between two codewords bounds
from below how far a vector is from any point of another codeword's region. The multi-sequence traversal takes cells
in the order of the sum of both halves' squared bounds, and ends where that sum exceeds the squared radius: what it
has not visited cannot hold a partner, so the recall that it reaches is 1. Candidates are then verified by their cosine
in double precision. The codebooks are fitted on at most ``SAMPLE`` vectors; every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, sorted_groups, stage
from .components import Forest, components

THRESHOLD = 0.98
#: The bound of the sample that the codebooks are fitted on. The grid of the largest label has a cell for about so many
#: vectors, with so many codewords an axis at least and at most.
SAMPLE, PER_CELL, LEAST_CODES, MOST_CODES = 8192, 512, 8, 1024
#: Residents and visitors of a cell are dealt to blocks of about this many.
BLOCK = 2048


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def codebook(sample: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """K-means codewords of the rows of ``sample``, the same on every run."""
    rng = np.random.default_rng(7)
    centers = sample[rng.permutation(len(sample))[:codes]].copy()
    for _ in range(rounds):
        nearest = np.argmin((centers**2).sum(1)[None, :] - 2 * sample @ centers.T, axis=1)
        counts = np.bincount(nearest, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centers, axis=0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to a largest magnitude between 1/2 and 1: squares neither vanish nor overflow, and but
    for components that are 1e-300 times smaller nothing is rounded."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _bounds(half: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest codeword, and the squared lower bound of its distance to each codeword's region."""
    norms = (centers**2).sum(1)
    d = np.maximum(0.0, (half**2).sum(1)[:, None] + norms[None, :] - 2 * half @ centers.T)
    own = np.argmin(d, axis=1)
    gap = np.sqrt(np.maximum(0.0, norms[own][:, None] + norms[None, :] - 2 * centers[own] @ centers.T))
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(gap > 1e-9, (d - d[np.arange(len(half)), own][:, None]) / (2 * gap), 0.0)
    return own, np.maximum(0.0, low) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: index pairs in the order of first[i] + second[j], both ascending, up to ``limit``."""
    out, heap, seen = [], [(first[0] + second[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            break
        out.append((i, j))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(first) and b < len(second) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[a] + second[b], a, b))
    return out


def traverse_many(first: np.ndarray, second: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of what ``traverse`` visits for each row's two ascending sequences, the rows stepped side by side.

    One step takes the next of every row's first sequence and as many of the second as the limit then allows; a row ends
    where that is none, as sums only grow.
    """
    rows, out = np.arange(len(first)), []
    for i in range(first.shape[1]):
        reach = (second[rows] <= limit - first[rows, i][:, None]).sum(1)
        rows, reach = rows[reach > 0], reach[reach > 0]
        if not len(rows):
            break
        j = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        out.append((np.repeat(rows, reach), np.full(len(j), i), j))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def _cells(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray], cut: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's own cell, and (row, cell) of the later ones that may hold a partner."""
    vectors = scaled(vectors)
    unit = vectors / np.sqrt((vectors**2).sum(1))[:, None]
    own1, low1 = _bounds(unit[:, :cut], books[0])
    own2, low2 = _bounds(unit[:, cut:], books[1])
    width = len(books[1])
    home = own1 * width + own2
    order1, order2 = np.argsort(low1, axis=1, kind="stable"), np.argsort(low2, axis=1, kind="stable")
    row, i, j = traverse_many(np.take_along_axis(low1, order1, 1), np.take_along_axis(low2, order2, 1), limit)
    cell = order1[row, i] * width + order2[row, j]
    later = cell > home[row]
    return home, row[later], cell[later]


def _matrix(packed: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)


def _verify(batches: Iterator[pd.DataFrame], threshold: float, kind: str) -> Iterator[pd.DataFrame]:
    """For each pair of blocks how many rows each vector links to, and edges that connect the same components."""
    for _, g in sorted_groups(batches, ["label", "dim", "cell", "hb", "rb"]):
        home = g["role"].to_numpy()
        if home.all() or not home.any():
            continue
        rid, mult, resident = g["rid"].to_numpy(), g["mult"].to_numpy(), g["home"].to_numpy()
        v = scaled(_matrix(g["vector"], kind))
        norm = np.sqrt((v**2).sum(1))
        h, m = np.nonzero(home)[0], np.nonzero(~home)[0]
        near = (v[h] @ v[m].T) / (norm[h][:, None] * norm[m][None, :]) >= threshold
        # two residents meet twice: the pair counts where the home's number is the smaller
        near &= ~resident[m][None, :] | (rid[h][:, None] < rid[m][None, :])
        to_h, to_m = near @ mult[m], near.T @ mult[h]
        counts = pd.DataFrame({"a": np.concatenate([rid[h], rid[m]]), "n": np.concatenate([to_h, to_m])})
        counts = counts[counts["n"] > 0].assign(b=-1)
        nodes, place = np.unique(rid, return_inverse=True)
        forest, edges = Forest(len(nodes)), []
        for i in np.nonzero(near.any(1))[0]:
            to = place[m[near[i]]]
            a, b = forest.add(np.full(len(to), place[h[i]]), to)
            edges.append(np.stack([nodes[a], nodes[b]]))
        if len(counts):
            e = np.concatenate(edges, axis=1)
            yield pd.concat([counts, pd.DataFrame({"a": e[0], "n": 0, "b": e[1]})])[["a", "b", "n"]]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows compare only within a label and a dimension. Equal vectors of a label are indexed once and counted as often as
    they occur; null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing. Magnitudes are free: components of 1e-300 or 1e300 compare by their direction. Repeated rows are rows of their own. A row without vec_id is never kept; an empty table gives no rows;
    other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    if rows.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & _usable(F.col("embedding")), F.lit(False)))
    distinct = rows.filter("ok").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first_id"))
    distinct = stage(distinct.select("label", F.size("embedding").alias("dim"), "embedding", "mult", "first_id", F.monotonically_increasing_id().alias("rid")), "vectors")
    counts = distinct.groupBy("label", "dim").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()  # a row for each dimension
    pairs = None
    for dim, n, most in sorted(tuple(r) for r in counts):
        own = distinct.filter(F.col("dim") == dim)
        found = _links(own, dim, n, most, threshold, block)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = spark.createDataFrame([], "a long, b long, n long")
    pairs = stage(pairs, "links")
    links = pairs.filter("b < 0").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(pairs.filter("b >= 0").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    per = distinct.join(links, distinct["rid"] == links["a"], "left").drop("a").join(roots, F.col("rid") == F.col("node"), "left")
    per = stage(per.select("label", "embedding", "first_id", "mult", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rid").alias("root")), "roots")
    least = per.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per = per.join(least, "root").select("label", "embedding", (F.col("links") + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = rows.filter("ok").join(per, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long"), F.col("component_id").cast("long"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(own: DataFrame, dim: int, n: int, most: int, threshold: float, block: int) -> DataFrame:
    """(a, b, n): how many rows vector a links to (b = -1), or an edge a-b, among ``n`` vectors, ``most`` of one label."""
    sample = bounded_sample(own.select("embedding", F.xxhash64("embedding").alias("draw")), n, "draw", SAMPLE)
    found = scaled(np.array([r[0] for r in sample.collect()], dtype=np.float64))
    unit = found / np.sqrt((found**2).sum(1))[:, None]
    codes = int(np.clip(round((most / PER_CELL) ** 0.5), LEAST_CODES, min(MOST_CODES, max(LEAST_CODES, len(unit) // 4))))
    cut = max(1, dim // 2)
    books = codebook(unit[:, :cut], codes), codebook(unit[:, cut:], codes) if cut < dim else np.zeros((1, 0))
    limit = max(0.0, 2 - 2 * threshold) + 1e-9
    label = own.schema["label"].dataType.simpleString()
    kind = "<f4" if own.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                b = whole.iloc[start : start + 1024]
                v = np.stack(b["embedding"].to_numpy())
                home, row, cell = _cells(v.astype(np.float64), books, cut, limit)
                by_row = np.argsort(row, kind="stable")
                visits = np.split(cell[by_row], np.cumsum(np.bincount(row, minlength=len(b)))[:-1])
                yield b[["label", "dim", "rid", "mult"]].assign(vector=[x.tobytes() for x in v.astype(kind)], home=home, visits=visits)

    # a row for each vector: cells are replicated, vectors only in the last shuffle
    placed = own.select("label", "dim", "rid", "mult", "embedding").mapInPandas(place, f"label {label}, dim int, rid long, mult long, vector binary, home long, visits array<long>")
    placed = stage(placed, "cells")
    keys = ["label", "dim", "cell"]
    at_home = F.struct(F.col("home").alias("cell"), F.lit(True).alias("home"))
    visit = F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home")))
    places = F.explode(F.concat(F.array(at_home), visit)).alias("p")
    per = placed.select("label", "dim", places).select("label", "dim", "p.cell", "p.home")
    per = per.groupBy(keys).agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("home").cast("long")).alias("homes"))
    per = per.filter("homes > 0 and all > 1").select(*keys, F.ceil(F.col("homes") / block).cast("int").alias("hn"), F.ceil(F.col("all") / block).cast("int").alias("rn"))
    rows = placed.select("label", "dim", "rid", "mult", "vector", places).select("label", "dim", "rid", "mult", "vector", "p.cell", "p.home").join(per, keys)
    own_h, own_r = F.pmod(F.xxhash64(F.lit(1), "rid"), "hn").cast("int"), F.pmod(F.xxhash64(F.lit(2), "rid"), "rn").cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("hn") - 1), lambda b: F.struct(b.alias("hb"), own_r.alias("rb"), F.lit(False).alias("role")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("rn") - 1), lambda b: F.struct(own_h.alias("hb"), b.alias("rb"), F.lit(True).alias("role")))
    rows = rows.withColumn("p", F.explode(F.when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)))
    rows = rows.select(*keys, "p.hb", "p.rb", "p.role", "rid", "mult", "home", "vector")
    groups = [*keys, "hb", "rb"]
    return rows.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(lambda b: _verify(b, threshold, kind), "a long, b long, n long")
