import datetime as dt
import random
import zlib

import pytest

from tallyforge.llm import validtime

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz"
CHANGES = "change_id long, client_id long, op string, valid_at timestamp_ntz, balance double, city string"
DAY = dt.timedelta(days=1)
EPOCH = dt.datetime(1970, 1, 1)


def stepped(sales, changes, batches=10, first_day=19723, days=152):
    """The rules told batch by batch, with plain lists."""
    batch = lambda d: max(0, min(batches - 1, (d - first_day) * batches // days))
    day = lambda t: (t - EPOCH).days
    of_sale = [batches - 1 if s[5] is None else batch(day(s[5])) for s in sales]
    changes = list({c: None for c in changes if c[3] is not None})
    of_change = [batches - 1 if c[0] is None else batch(day(c[3]) + zlib.crc32(str(c[0]).encode()) % 4) for c in changes]
    versions, waiting, out, sold, valid = {}, [], [], None, None
    for k in range(batches + 1):
        floor_sold, floor_valid = (None if x is None else x - DAY for x in (sold, valid))
        h = None if None in (floor_sold, floor_valid) else min(floor_sold, floor_valid)
        come = [c for c, b in zip(changes, of_change, strict=True) if b == k]
        for c in come:
            if floor_valid is not None and c[3] < floor_valid:
                out.append(("late", c[0], k, None, None, None, None))
            elif c[1] is not None:
                versions.setdefault(c[1], []).append(c)
        new = [s for s, b in zip(sales, of_sale, strict=True) if b == k]
        still = []
        for s in [*new, *waiting]:
            if s[4] is None or (h is not None and s[4] < h) or k == batches:
                held = versions.get(s[1], []) if s[1] is not None else []
                fits = [v for v in held if s[4] is not None and v[3] <= s[4]]
                v = max(fits, key=lambda v: (v[3], v[0])) if fits else None
                cents = None if v is None or v[4] is None else int((100 * v[4] + 0.5) // 1)
                out.append(("sale", s[0], k, len(held), v and v[0], cents, v and v[2]))
            else:
                still.append(s)
        waiting = still
        if h is not None and k < batches:
            for client, held in versions.items():
                past = sorted((v for v in held if v[3] <= h), key=lambda v: (v[3], v[0]))
                versions[client] = past[-1:] + [v for v in held if v[3] > h]
        for s in new:
            sold = s[4] if sold is None or s[4] is not None and s[4] > sold else sold
        for c in come:
            valid = c[3] if valid is None or c[3] > valid else valid
    return out


def tables(seed, n=400, gap=None):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(hours=r.randrange(0, 24 * 118))
    sales, changes = [], []
    for i in range(n):
        sold = None if r.random() < 0.03 else when()
        arrived = (sold or when()) + dt.timedelta(seconds=r.choice([0, 5, 90_000, 900_000]))
        if gap and gap[0] <= (arrived - start).days < gap[1]:
            continue
        sales.append((i, None if r.random() < 0.05 else r.choice([7, 7, 7, *range(12)]), "done", 1.0, sold, None if r.random() < 0.01 else arrived))
    for i in range(n):
        valid = None if r.random() < 0.03 else when()
        changes.append((i, r.choice([7, 7, *range(12)]), r.choice("IUD"), valid, None if r.random() < 0.05 else round(r.uniform(-99, 999), 2), "x"))
    return sales + sales[:3], changes + changes[:20]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("seed", "rows_per_cell"), [(1, 20_000), (2, 60)])
def test_rules_step_by_step(spark, seed, rows_per_cell):
    """With few rows a cell the busy client is dealt by day; the results are the same."""
    sales, changes = tables(seed, gap=(40, 70))
    got = validtime.enriched(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), rows_per_cell=rows_per_cell).collect()
    assert order(got) == order(stepped(sales, changes))


def test_empty_tables(spark):
    sales, changes = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert validtime.enriched(sales, changes, batches=2).collect() == []


def test_latest_version_of_a_page():
    import numpy as np

    page = np.array([(1, 5, 1, 0, 0), (1, 5, 2, 0, 0), (1, 9, 3, 0, 0), (2, 1, 4, 0, 0)], validtime._VERSION)
    assert validtime._latest(page, np.array([1, 1, 1, 2, 3]), np.array([4, 5, 8, 100, 100])).tolist() == [-1, 1, 1, 3, -1]
    assert validtime._latest(page[:0], np.array([1]), np.array([4])).tolist() == [-1]


def test_horizon_is_the_smaller_watermark_of_earlier_batches():
    h = validtime.horizons({0: (10 * validtime.DAY, None), 2: (3, 20 * validtime.DAY)}, 3)
    assert [x.h for x in h] == [validtime.NEVER] * 3 + [9 * validtime.DAY]
    assert [x.changes for x in h] == [validtime.NEVER] * 3 + [19 * validtime.DAY]
    assert [x.flush for x in h] == [False] * 3 + [True]
