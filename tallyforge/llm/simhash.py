"""Operator 3: SimHash near-dedup by anchor-point covering.

A document's fingerprint has a bit for each of the 64 that is set in over half of the XXH64 of its word shingles. Two
fingerprints that differ in at most three bits differ in at most one bit of their low or of their high 32. For either
half the anchors are the words of a covering code: the perfect [31,26] Hamming code with one free bit. Each half lies
within the code's covering radius 1 of exactly one anchor, its home. A fingerprint is replicated to every anchor within
radius plus threshold, 1 + 1, so that it meets all its partners at their homes: no pair is lost. Only different
fingerprints are compared, so exact copies cost nothing. Cut into three pieces instead of halves (``THIRDS``, with the
[15,11] code and more free bits) the same covering reaches five bits; the pipeline's dedup stage begins with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, sorted_groups, stage
from .components import Forest, components

THRESHOLD = 3
SHINGLE = 3
HASH_SEED = 42
#: Homes and members of an anchor are dealt to blocks of about this many, each pair of blocks being one group.
BLOCK = 4096
_CHUNK = 1 << 16
#: Fixed values: (shift, width, k) of each piece of a fingerprint; its low 2^k - 1 bits belong to the Hamming code, the others are
#: free. Of n pieces one differs in at most one bit where the whole differs in at most 2n - 1.
HALVES = ((0, 32, 5), (32, 32, 5))
THIRDS = ((0, 21, 4), (21, 21, 4), (42, 22, 4))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; null, or no word: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), HASH_SEED)]
    elif shingle == 3:
        hashes = [digest(b"%b %b %b" % t, HASH_SEED) for t in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), HASH_SEED) for i in range(len(words) - shingle + 1)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none zero."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp long")


def _home(piece: Column, k: int) -> tuple[Column, Column]:
    """The nearest codeword of a piece (bits from 2^k - 1 on are free) and the position that differs, 0 if none."""
    # the positions whose number has a bit, as a mask (position p is bit p-1)
    masks = [sum(1 << (p - 1) for p in range(1, 1 << k) if p >> j & 1) for j in range(k)]
    parity = [F.bit_count(piece.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(masks)]
    at = sum(parity[1:], parity[0]).cast("int")
    bit = F.when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), at - 1)).otherwise(F.lit(0).cast("long"))
    return piece.bitwiseXOR(bit), at


def _replicas(distinct: DataFrame, pieces: tuple[tuple[int, int, int], ...] = HALVES) -> DataFrame:
    """(anchor, fp, home) of every fingerprint at its home and at those anchors in reach whose number is larger; all pieces have
    the same code."""
    (k,) = {k for _, _, k in pieces}
    cut = [F.struct(F.lit(i).alias("no"), F.lit(width).alias("width"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("half")) for i, (shift, width, _) in enumerate(pieces)]
    halves = distinct.withColumn("part", F.explode(F.array(*cut)))
    halves = halves.select("fp", "part.no", "part.width", "part.half")
    home, at = _home(F.col("half"), k)
    halves = halves.withColumn("home", home).withColumn("at", at)
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p - 1).cast("int"))
    # two flips that lead from the half to another codeword: positions j and k with j xor k = at
    flips = F.filter(F.sequence(F.lit(1), F.lit((1 << k) - 1)), lambda j: (F.col("at") > 0) & (j.bitwiseXOR(F.col("at")) > j))
    near = F.transform(flips, lambda j: F.col("half").bitwiseXOR(one(j)).bitwiseXOR(one(j.bitwiseXOR(F.col("at")))))
    free = F.transform(F.sequence(F.lit(1 << k), F.col("width")), lambda j: F.col("home").bitwiseXOR(one(j)))
    near = F.filter(F.concat(near, free), lambda a: a > F.col("home"))
    places = F.concat(F.array(F.struct(F.col("home").alias("anchor"), F.lit(True).alias("home"))), F.transform(near, lambda a: F.struct(a.alias("anchor"), F.lit(False).alias("home"))))
    rows = halves.select("fp", "no", F.explode(places).alias("p"))
    return rows.select((F.col("p.anchor") * len(pieces) + F.col("no")).alias("anchor"), "fp", F.col("p.home").alias("home"))


def _compare(batches: Iterator[pd.DataFrame], threshold: int = THRESHOLD) -> Iterator[pd.DataFrame]:
    """Edges that connect what is within the threshold in each group: a forest, not all pairs."""
    src, dst = [], []
    for _, g in sorted_groups(batches, ["anchor", "hb", "rb"]):
        fp, home = g["fp"].to_numpy(), g["role"].to_numpy()
        homes, members = fp[home], np.unique(fp[~home])
        if not len(homes) or not len(members):
            continue
        nodes = np.unique(fp)
        forest, own = Forest(len(nodes)), np.searchsorted(nodes, members)
        for h, at in zip(homes, np.searchsorted(nodes, homes), strict=True):
            # unsigned: of a negative number the bits of its absolute value would be counted
            differ = np.bitwise_count((members ^ h).view(np.uint64))
            near = own[(differ <= threshold) & (differ > 0)]
            a, b = forest.add(np.full(len(near), at), near)
            src.append(nodes[a])
            dst.append(nodes[b])
        if len(src) > 2000:
            yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})
            src, dst = [], []
    if src:
        yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})


def links(distinct: DataFrame, block: int = BLOCK, pieces: tuple[tuple[int, int, int], ...] = HALVES) -> DataFrame:
    """(src, dst) edges between fingerprints that connect all within the threshold, for ``distinct`` (fp): three bits by halves, five
    by thirds."""
    rows, threshold = stage(_replicas(distinct, pieces), "anchors"), 2 * len(pieces) - 1
    per = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("h"))
    per = per.filter("h > 0 and n > 1").select("anchor", F.ceil(F.col("h") / block).cast("int").alias("hn"), F.ceil(F.col("n") / block).cast("int").alias("rn"))
    rows = rows.join(per, "anchor")
    own_h, own_r = F.pmod(F.xxhash64(F.lit(1), "fp"), "hn").cast("int"), F.pmod(F.xxhash64(F.lit(2), "fp"), "rn").cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("hn") - 1), lambda b: F.struct(b.alias("hb"), own_r.alias("rb"), F.lit(False).alias("role")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("rn") - 1), lambda b: F.struct(own_h.alias("hb"), b.alias("rb"), F.lit(True).alias("role")))
    rows = rows.select("anchor", "fp", F.explode(F.when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)).alias("p"))
    rows = rows.select("anchor", "p.hb", "p.rb", "fp", "p.role").repartition("anchor", "hb", "rb").sortWithinPartitions("anchor", "hb", "rb")
    return rows.mapInPandas(lambda batches: _compare(batches, threshold), "src long, dst long")


def classes(fps: DataFrame) -> DataFrame:
    """``fps`` (doc_id, fp) with component_id: the smallest doc_id that links reach, itself included."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    linked = stage(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per = linked.join(least, "root").select("fp", "component_id")
    return fps.join(per, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have fingerprint zero and link like any other; repeated rows stay repeated; a null
    doc_id is never a component_id unless its whole component is null; an empty table gives no rows; other columns are
    not looked at. Very long texts are hashed in chunks.
    """
    rows = classes(stage(fingerprints(docs, shingle), "fingerprints"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that lead their component; see ``leaders``."""
    return leaders(docs, near_duplicates(docs, shingle))


def leaders(docs: DataFrame, near: DataFrame) -> DataFrame:
    """One document of each component of ``near`` (doc_id, component_id), and of its repeated rows one.

    Documents without an id can't lead one that has: they go if they are near one that has, unless another group consists
    of such documents alone; of equal texts without an id one stays.
    """
    nth = free_name(docs, "nth")
    lead = near.filter("doc_id <=> component_id").select("doc_id").distinct()
    lead = lead.select(F.col("doc_id").alias(f"{nth}_id"))
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    rows = docs.join(lead, F.col("doc_id").eqNullSafe(F.col(f"{nth}_id")), "left_semi")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", nameless).orderBy(F.xxhash64("text"))))
    return rows.filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
