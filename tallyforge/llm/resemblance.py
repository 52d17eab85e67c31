"""Near copies by the exact Jaccard similarity of their sets of word shingles; the pipeline's dedup stage.

Sets get SimHash fingerprints, and an anchor-point covering over thirds of them (``simhash.links``) brings together what
differs in at most five bits. At similarity 0.8 fingerprints differ in about ten of 64 bits, and in more by chance: no covering
reaches so far without comparing nearly all pairs. What lies beyond the covering's reach comes from min-hash bands: a pair at
the threshold shares none of ``BANDS`` bands of ``ROWS`` minima with probability (1 - 0.8 ** 3) ** 32, about 1e-10, a closer pair
with less. Every candidate is verified on whole sets, so what is linked is never below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sorted_groups, stage
from .components import Forest, components
from .simhash import HASH_SEED, THIRDS, leaders, majority
from .simhash import links as near_fingerprints

SHINGLE = 5
BANDS, ROWS = 32, 3
#: Members of a band are dealt to blocks of about this many, and of about so many shingles: what a task holds of a pair
#: of blocks follows these bounds and the longest text.
BLOCK, HELD = 2048, 1 << 20
#: Rows that a task hashes before it hands them on.
_ROWS = 512
_CHUNK = 1 << 12
_rng = np.random.default_rng(HASH_SEED)
#: The orders of shingles of which a set's minima are taken, and the mixing of a band's minima.
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBERS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted XXH64 of a text's distinct runs of five words; of fewer words one run; of none the set is empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), HASH_SEED)], dtype=np.uint64)
    runs = zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)
    return np.unique(np.array([digest(b"%b %b %b %b %b" % r, HASH_SEED) for r in runs], dtype=np.uint64))


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), HASH_SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """The bands of a set; an empty set has none."""
    if not len(found):
        return np.empty(0, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), _CHUNK):
        np.minimum(least, (found[i : i + _CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    out = _NUMBERS.copy()
    for r, m in enumerate(_MIX):
        out = (out ^ least.reshape(BANDS, ROWS)[:, r]) * m
        out ^= out >> np.uint64(29)
    return out


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in slices of few rows: the sets of a whole batch are never held together."""
    for b in batches:
        for i in range(0, len(b), _ROWS):
            yield b.iloc[i : i + _ROWS].reset_index(drop=True)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, fp, bands): equal sets have equal keys; n is how many shingles a set has, fp their SimHash fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            sets = [shingles(t if isinstance(t, str) else None) for t in b["text"]]
            key = np.array([_key(s) for s in sets], dtype=np.uint64).view(np.int64)
            found = [bands(s).view(np.int64) for s in sets]
            fp = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": key, "n": [len(s) for s in sets], "fp": fp, "bands": found})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, key long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, found) of each of ``wanted`` (key, first_id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            sets = [shingles(t if isinstance(t, str) else None) for t in b["text"]]
            key = np.array([_key(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"key": key, "found": [s.view(np.int64) for s in sets]})

    ids = wanted.select(F.col("first_id")).distinct()
    held = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("first_id")), "left_semi").select("text")
    return held.mapInPandas(run, "key long, found array<long>").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (src, dst) of ``pairs`` whose sets have a Jaccard similarity of at least 0.8, in whole numbers."""
    side = lambda k, s: sets.select(F.col("key").alias(k), F.col("found").alias(s), F.size("found").alias(f"n_{s}"))
    rows = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst").filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    both = F.size(F.array_intersect("a", "b"))
    return rows.filter(5 * both >= 4 * (F.col("n_a") + F.col("n_b") - both)).select("src", "dst")


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between the components that pairs within the threshold connect, for each pair of a band's blocks: a forest.

    A row's sizes of intersection with all others come from an inverted index of the group's shingles, so rows that share
    nothing cost nothing and no pair is ever a row.
    """
    for (_, one, two), g in sorted_groups(batches, ["band", "one", "two"]):
        nodes, place = np.unique(g["root"].to_numpy(), return_inverse=True)
        if len(nodes) < 2:
            continue
        sets = g["found"].to_list()
        n, block = np.array([len(s) for s in sets]), g["own"].to_numpy()
        which = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        owners = np.repeat(np.arange(len(sets), dtype=np.int32), n)[np.argsort(which, kind="stable")]
        ends = np.cumsum(np.bincount(which))
        starts, offsets = ends - np.bincount(which), np.cumsum(n) - n
        forest, src, dst = Forest(len(nodes)), [], []
        for r in np.nonzero(block == one)[0]:
            mine = which[offsets[r] : offsets[r] + n[r]]
            size = ends[mine] - starts[mine]
            at = np.repeat(starts[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both = np.bincount(owners[at], minlength=len(sets))
            near = (5 * both >= 4 * (n[r] + n - both)) & (place != place[r]) & (block == two)
            to = place[near]
            a, b = forest.add(np.full(len(to), place[r]), to)
            src.append(nodes[a])
            dst.append(nodes[b])
        if src:
            yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(src, dst) candidates of ``distinct`` (key, n, fp) by the covering: edges that connect the fingerprints within five bits, told
    by the least key of each, and each set with the least one of its fingerprint."""
    sets = distinct.filter("n > 0").select("key", "fp")
    least = stage(sets.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    side = lambda end: least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_key"))
    far = near_fingerprints(least.select("fp"), pieces=THIRDS).join(side("src"), "src").join(side("dst"), "dst")
    same = sets.join(least, "fp").filter("key != least").select(F.col("least").alias("src"), F.col("key").alias("dst"))
    return far.select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst")).unionByName(same).distinct()


def links(distinct: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst) edges that connect all candidates within the threshold, for ``distinct`` (key, n, first_id, fp, bands).

    First come the pairs of the SimHash covering, and each set with the least of all that it shares a band with; only bands
    whose members are not one component by then compare the members of different components, in pairs of blocks. A large
    group of near copies so is one component before anything is compared in all pairs.
    """
    prints = stage(fingerprint_pairs(distinct), "prints")
    rows = distinct.select("key", F.col("n").alias("held"), F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("head")).filter("n > 1").drop("n")
    members = stage(rows.join(shared, "band"), "members")
    wanted = reduce(DataFrame.union, (members.select("key"), prints.select("src"), prints.select("dst"))).distinct()
    sets = stage(_sets(docs, distinct.select("key", "first_id").join(wanted, "key")), "sets")
    stars = members.groupBy("key").agg(F.min("head").alias("head")).filter("key != head").select(F.col("head").alias("src"), F.col("key").alias("dst"))
    first = stage(_verified(prints.unionByName(stars).distinct(), sets), "first")
    roots = components(first).select(F.col("node").alias("key"), "root")
    placed = stage(members.join(roots, "key", "left").select("band", "key", "held", F.coalesce("root", "key").alias("root")), "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("held") / HELD)).cast("int").alias("k")).filter("lo != hi").select("band", "k")
    open_ = placed.join(mixed, "band").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "key"), "k").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("own", j).alias("one"), F.greatest("own", j).alias("two")))
    dealt = open_.select("band", "key", "root", "own", F.explode(meets).alias("p")).select("band", "key", "root", "own", "p.one", "p.two").join(sets, "key")
    groups = ["band", "one", "two"]
    found = dealt.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(_compare, "src long, dst long")
    return first.unionByName(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts are one component; repeated rows stay repeated; a null doc_id is never a component_id
    unless its whole component is null; an empty table gives no rows; other columns are not looked at.
    """
    rows = stage(_sketches(docs), "sketches")
    distinct = stage(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "distinct")
    roots = components(links(distinct, docs)).select(F.col("node").alias("key"), "root")
    linked = stage(distinct.select("key", "first_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "roots")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "key").join(linked.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their component; see ``simhash.leaders``."""
    return leaders(docs, near_duplicates(docs))
