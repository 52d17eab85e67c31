"""Operators 2 and 3 against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tallyforge.llm import embed_dedup, simhash
from tallyforge.llm.components import Forest, components


def labelled(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 75), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[75] == 50 and got[249] == 200
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_forest_connects_the_same():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    kept = Forest(60).add(a, b)
    assert labelled(60, zip(a, b, strict=True)) == labelled(60, zip(*kept, strict=True)) and len(kept[0]) <= 59


@pytest.mark.parametrize("block", [8, 4096])
def test_simhash_links_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = [int(x) for x in base]
    for x in base:
        for _ in range(12):
            y = int(x)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                y ^= 1 << int(bit)
            fps.append(y if y < 1 << 63 else y - (1 << 64))
    near = sorted(set(fps))
    u = np.array(near, dtype=np.int64).view(np.uint64)
    pairs = [(i, int(j)) for i in range(len(u)) for j in np.nonzero(np.bitwise_count(u ^ u[i]) <= 3)[0]]
    want = labelled(len(u), pairs)
    edges = simhash.links(spark.createDataFrame([(f,) for f in near], "fp long"), block)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert [got.get(f, f) for f in near] == [near[w] for w in want]


def test_simhash_rows_and_edges(spark):
    rows = [(5, "A b\tc D"), (2, "a B c d"), (9, None), (7, ""), (7, ""), (11, "one two"), (None, "a b c d"), (12, "w " * 70_000)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5] == got[2] == got[None] == (got[2][0], 2)
    assert got[9] == got[7] == ("0" * 16, 7) and got[11][1] == 11
    import xxhash

    assert got[11][0] == f"{xxhash.xxh64_intdigest(b'one two', 42):016x}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.deduplicated(docs.withColumn("Root", docs["doc_id"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 11, 12] and kept.columns == ["doc_id", "text", "Root"]
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "e f g h"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.deduplicated(nameless).collect()) == ["a b c d", "e f g h"]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("block", "per_cell"), [(7, 2), (2048, 512)])
def test_embeddings_by_brute_force(spark, block, per_cell, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_CELL", per_cell)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    v = np.repeat(centers, 12, axis=0) + rng.normal(scale=0.12, size=(360, 16))
    v[:20] = v[0]
    v[40] *= 3
    rows = [(i, [float(x) for x in np.float32(v[i])], int(i % 2) if i % 50 else None) for i in range(360)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, [], 1), (1005, [1.0] * 8, 1), (5, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).toPandas()
    ok = [i for i, r in enumerate(rows) if r[2] is not None and r[1] and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    e = np.array([rows[i][1] for i in ok])
    n = np.sqrt((e**2).sum(1))
    lab = np.array([rows[i][2] for i in ok])
    link = ((e @ e.T) / n[:, None] / n[None] >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    roots = labelled(len(ok), zip(*np.nonzero(link), strict=True))
    least = {}
    for k, i in enumerate(ok):
        if rows[i][0] is not None:
            least[roots[k]] = min(least.get(roots[k], 10**9), rows[i][0])
    want = sorted([(str(rows[i][0]), int(link[k].sum()), least[roots[k]]) for k, i in enumerate(ok)] + [(str(r[0]), 0, r[0]) for i, r in enumerate(rows) if i not in set(ok)])
    have = sorted((str(None if v != v else int(v)), int(k), int(c)) for v, k, c in zip(got.vec_id, got.n_links, got.component_id, strict=True))
    assert have == want and len(got) == len(rows)


def test_embeddings_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert len(embed_dedup.traverse(np.array([0.0, 1, 5]), np.array([0.0, 2]), 3)) == 4


def test_traversals_visit_the_same_cells():
    rng = np.random.default_rng(4)
    first, second = np.sort(rng.random((50, 6)), axis=1), np.sort(rng.random((50, 9)), axis=1)
    first[:10, 0] = second[:10, 0] = 0
    row, i, j = embed_dedup.traverse_many(first, second, 0.7)
    want = {(r, a, b) for r in range(50) for a, b in embed_dedup.traverse(first[r], second[r], 0.7)}
    assert set(zip(row.tolist(), i.tolist(), j.tolist(), strict=True)) == want and len(row) == len(want)


def test_grid_prunes_at_default_constants():
    rng = np.random.default_rng(9)
    v = np.repeat(rng.normal(size=(60, 64)), 20, axis=0) + rng.normal(scale=0.02, size=(1200, 64))
    unit = v / np.sqrt((v**2).sum(1))[:, None]
    books = embed_dedup.codebook(unit[:, :32], embed_dedup.LEAST_CODES), embed_dedup.codebook(unit[:, 32:], embed_dedup.LEAST_CODES)
    home, row, cell = embed_dedup._cells(v, books, 32, 0.04)
    meets = np.zeros((1200, 1200), dtype=bool)
    for c in set(home.tolist()):
        here = np.nonzero(home == c)[0]
        meets[np.ix_(here, here)] = True
        meets[np.ix_(row[cell == c], here)] = True
    meets |= meets.T
    near = unit @ unit.T >= 0.98
    assert meets[near].all() and len(set(home.tolist())) > 20 and meets.mean() < 0.5


def test_embeddings_threshold_ties_and_clashing_columns(spark):
    # cosines of exactly 0.6 and 0.8: the threshold itself links
    rows = [(1, [1.0, 0.0], 0, 9, True), (2, [3.0, 4.0], 0, 9, True), (3, [0.0, 1.0], 0, 9, True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, Cell int, Home boolean")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, threshold=0.8).collect()}
    assert got == {1: (0, 1), 2: (1, 2), 3: (1, 2)}


def test_magnitudes_do_not_matter(spark):
    """Directions compare at 1e-300 and 1e300 as at 1."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows, scales = [], (1e-300, 1.0, 1e200, 3e-170, 1e300)
    for i, scale in enumerate(scales):
        rows += [(10 * i + j, (v * scale).tolist(), 1) for j, v in enumerate(base)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {10 * i + j: (len(scales) - 1, j) for i in range(len(scales)) for j in range(6)}
