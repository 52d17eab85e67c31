"""Change feeds, hash trees, similar names, numbered records and quoted texts, against plain Python."""

from __future__ import annotations

import csv
import random

from pyspark.sql import functions as F

from tallyforge.operators import changes, merkle, retrieval, similarity
from tallyforge.sources import files


def state(spark, rows):
    return spark.createDataFrame(rows, "id int, a string, b int, loaded int")


def test_feed_is_what_changed(spark, tmp_path):
    r = random.Random(1)
    states = []
    for v in range(4):
        states.append({i: (r.choice(["x", None]), r.choice([1, None])) for i in range(60) if r.random() < 0.7})
    frames = [state(spark, [(i, *x, v) for i, x in s.items()]) for v, s in enumerate(states)]
    feed = f"file://{tmp_path}/feed"
    for v in range(1, 4):
        changes.record(changes.changes(frames[v - 1], frames[v], ["id"], ("loaded",)), feed, v)
    read = spark.read.parquet(feed)
    for low, high in ((0, 3), (0, 1), (1, 3), (2, 2)):
        got = changes.between(read, ["id"], low, high, ("loaded",)).collect()
        was, now = states[low], states[high]
        want = {(i, "insert") for i in now.keys() - was.keys()} | {(i, "delete") for i in was.keys() - now.keys()}
        want |= {(i, c) for i in was.keys() & now.keys() if was[i] != now[i] for c in ("update_preimage", "update_postimage")}
        assert {(x["id"], x["change"]) for x in got} == want and len(got) == len(want)
        for x in got:
            side = was if x["change"] in ("delete", "update_preimage") else now
            assert (x["a"], x["b"]) == side[x["id"]]
            if x["change"].startswith("update"):
                assert x["changed"] == [c for c, p, q in zip("ab", was[x["id"]], now[x["id"]], strict=True) if p != q]


def test_a_trees_root_is_the_tables(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    one = merkle.root(rows, ["id"])
    assert one == merkle.root(rows.repartition(7).orderBy(F.desc("id")), ["id"]) == merkle.root(rows.select("n", "id", "v"), ["id"])
    other = rows.withColumn("v", F.when(F.col("id") == 77, None).otherwise(F.col("v")))
    assert merkle.root(other, ["id"]) != one and merkle.root(rows.unionByName(rows.limit(1)), ["id"]) != one
    assert merkle.root(rows.limit(0), ["id"]) == merkle.root(rows.limit(0), ["id"])
    a, b = merkle.tree(rows, ["id"]), merkle.tree(other, ["id"])
    assert a.filter("level = 0").first()["n"] == 500
    assert merkle.differing_ranges(a, b).count() == 1  # one row differs: one range is read
    assert merkle.differences(rows, other.filter("id <> 5"), ["id"]).orderBy("id").collect() == [(5, "MISSING"), (77, "MISMATCH")]


def test_similar_names_by_all_pairs(spark):
    r = random.Random(2)
    names = [(i, i % 2, " ".join(r.choices("red blue hot cold ring gear bolt nut plate rod".split(), k=r.randint(1, 6)))) for i in range(160)] + [(200, 0, None), (201, 0, "--")]
    df = spark.createDataFrame(names, "k int, g int, name string")
    sets = {}
    for k, g, name in names:
        if name and set(name.replace("-", " ").split()):
            sets.setdefault((g, frozenset(name.replace("-", " ").split())), k)
    for t in (0.5, 0.6, 0.75, 0.8, 1.0):
        got = {tuple(x)[:6] for x in similarity.similar(df, ["g"], "k", "name", t).collect()}
        want = set()
        for (g, a), ka in sets.items():
            for (h, b), kb in sets.items():
                if g == h and ka < kb and len(a & b) >= t * len(a | b) - 1e-12:
                    want.add((g, ka, kb, len(a & b), len(a), len(b)))
        assert got == want, t
    assert similarity.classes(df, ["g"], "k", "name").count() == 160


def test_possible_matches(spark):
    rows = [(1, "p", "People trained (Number, Custom)"), (2, "p", "People - trained"), (3, "p", "People trained in schools"), (4, "q", "People trained"), (5, "p", None), (6, "p", "(x)"), (7, "p", "Peo")]
    got = {tuple(x)[1:] for x in similarity.possible_matches(spark.createDataFrame(rows, "k int, g string, name string"), ["g"], "k", "name", 10).collect()}
    assert got == {(1, 2, "SAME_BASE"), (1, 3, "PREFIX"), (2, 3, "PREFIX")}


def test_records_are_numbered_over_blocks(spark, tmp_path):
    rows = [["Banner", "", ""], ["id", "name", "more"], ["ID", "Name", "api"]] + [[str(i), "id" if i % 50 == 0 else f'n "{i}", x', "name" if i % 50 == 0 else "y"] for i in range(800)] + [["", " ", ""], ["Banner", "", ""]]
    for k in range(2):
        with (tmp_path / f"f{k}.csv").open("w", newline="") as f:
            csv.writer(f).writerows(rows)
    aliases = {"id": ("ID",), "name": ("Name",)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "20k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = files.read_csv(spark, f"file://{tmp_path}/*.csv", aliases, ("id", "name"), multiline=False)
            for k in range(2):
                found = {x["_record"]: (x["id"], x["name"], x["_extra_fields"]["more"]) for x in got.filter(F.col("_file").endswith(f"f{k}.csv")).collect()}
                # a banner's text below the header is a row like any other
                assert found == {i: tuple(v) if i < 805 else ("Banner", None, None) for i, v in enumerate(rows, 1) if 3 < i and i != 804}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoting_by_all_pairs(spark):
    r = random.Random(3)
    words = "a bb ccc dd e ff g".split()
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(60)] + [None, ""]
    items = [" ".join(r.choices(words, k=n)) for n in (1, 1, 2, 3, 4, 5, 6, 7, 7, 9)] + [t[4:30] for t in texts[:8]] + ["cc d", "b", ""]
    docs, asked = spark.createDataFrame([*enumerate(texts)], "d int, text string"), spark.createDataFrame([*enumerate(items)], "i int, text string")
    got = sorted(map(tuple, retrieval.quoting(docs, "d", asked, "i").collect()))
    assert got == sorted((d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if t is not None and x in t)
    hits = {(x["d"], x["i"]): x["start"] for x in retrieval.phrase_hits(docs, "d", asked, "i").collect()}
    assert hits == {(d, i): texts[d].index(items[i]) + 1 for d, i in got}
