"""Operator 11: sales enriched with the version of their client that was valid when they were made.

A stateful query keeps versions and waiting sales in pages of one day (MapState), with a directory of the pages and their
counts and a count of versions for each client. A sale looks into the page of its own day, then into the nearest earlier
ones. The horizon H, the smaller of two watermarks, drains the pages of waiting sales and drops the pages of versions
before it; of each client the last version up to H stays, in the page of kept ones.

State is dealt by cell. A cell holds some clients, so many that it sees about ``rows_per_cell`` rows; a client with more
rows than that has a cell for each day, so that no client's rows meet in one task. Such cells tell the sink how many
versions they hold and which is the last; the next batch brings each of them what its neighbours hold: a row for each
such client and day.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import stage, workspace

DAY = 86_400_000_000
LATENESS = DAY
#: No value; before and after all times.
NONE, NEVER, EVER = -(1 << 63), -(1 << 62), 1 << 62
#: The page that holds each client's last version up to H.
KEPT = -(1 << 31)
VERSION, SALE, TICK, PRIOR = 0, 1, 2, 3
_VERSION = np.dtype([("client", "<i8"), ("at", "<i8"), ("id", "<i8"), ("cents", "<i8"), ("op", "<i4")])
_SALE = np.dtype([("client", "<i8"), ("at", "<i8"), ("id", "<i8")])
_FED = "cell string, kind int, client long, at long, id long, cents long, op string"
_OUT = "rec string, id long, n_held long, change_id long, balance_cents long, op string, slice int, first_at long, last_at long, waiting long, batch int"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # the local copies that earlier starts leave on executors go soon
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


@dataclass(frozen=True)
class Horizon:
    """What a batch knows of the batches before it: changes below ``changes`` are late, ``h`` drains and prunes."""

    batch: int
    changes: int
    h: int
    flush: bool = False


def horizons(largest: dict[int, tuple[int | None, int | None]], batches: int) -> list[Horizon]:
    """``largest``: by batch the largest sold_at and valid_at. The last horizon is that of what then still waits."""
    out, sold, valid = [], None, None
    for k in range(batches + 1):
        below = [NEVER if x is None else x - LATENESS for x in (sold, valid)]
        out.append(Horizon(k, below[1], min(below), k == batches))
        s, v = largest.get(k, (None, None))
        sold, valid = (x if y is None else y if x is None else max(x, y) for x, y in ((sold, s), (valid, v)))
    return out


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["op"], rows["cents"], rows["id"], rows["at"], rows["client"]))]


def _latest(page: np.ndarray, client: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each (client, at) the place in the page of the client's last version up to then, or -1."""
    n, m = len(page), len(client)
    clients, times = np.concatenate((page["client"], client)), np.concatenate((page["at"], at))
    order = np.lexsort((np.concatenate((page["id"], np.zeros(m, np.int64))), np.arange(n + m) >= n, times, clients))
    place = np.maximum.accumulate(np.where(order < n, np.arange(n + m), -1))
    before = np.where(place >= 0, order[place], -1)
    out = np.full(m, -1)
    asked = order >= n
    out[order[asked] - n] = before[asked]
    return np.where((out >= 0) & (page["client"][out] == client), out, -1) if n else out


class Pages(StatefulProcessor):
    """One cell's pages. The horizon is fixed for a start of the query; each start is one batch."""

    def __init__(self, horizon: Horizon) -> None:
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getMapState("versions", "day int", "rows binary, ops array<string>")
        self.waiting = handle.getMapState("waiting", "day int", "rows binary")
        self.directory = handle.getValueState("directory", "days array<int>, versions array<int>, waiting_days array<int>, waiting array<int>")
        self.counts = handle.getValueState("counts", "clients binary, n binary")

    def close(self) -> None:
        pass

    # pages

    def _page(self, day: int) -> np.ndarray:
        """A page of versions; its operations are numbered anew by this call's list."""
        if day not in self.pages:
            page = np.zeros(0, _VERSION)
            if day in self.sizes:
                data, ops = self.versions.getValue((day,))
                page = np.frombuffer(bytes(data), _VERSION).copy()
                code = np.array([self._op(x) for x in ops] + [-1], np.int32)
                page["op"] = code[page["op"]]
            self.pages[day] = page
        return self.pages[day]

    def _op(self, name: str | None) -> int:
        if name is None:
            return -1
        return self.op_of.setdefault(name, len(self.op_of))

    def _put(self, day: int, rows: np.ndarray) -> None:
        self.pages[day] = rows
        self.changed.add(day)

    def _write(self) -> None:
        names = [*self.op_of]
        for day in self.changed:
            rows = self.pages[day]
            if len(rows):
                used, code = np.unique(rows["op"], return_inverse=True)
                shift = int(len(used) > 0 and used[0] < 0)
                rows = rows.copy()
                rows["op"] = code - shift
                self.versions.updateValue((day,), (rows.tobytes(), [names[i] for i in used[shift:]]))
                self.sizes[day] = len(rows)
            elif day in self.sizes:
                self.versions.removeKey((day,))
                del self.sizes[day]

    def _take(self, horizon: Horizon, rows: np.ndarray) -> np.ndarray:
        """The sales that are due, of those that come and those that wait; the others go to their days' pages."""
        due = (rows["at"] == NONE) | (rows["at"] < horizon.h) | horizon.flush
        out, later = [rows[due]], rows[~due]
        for day in [d for d in self.queue if horizon.flush or d <= horizon.h // DAY]:
            page = np.frombuffer(bytes(self.waiting.getValue((day,))[0]), _SALE)
            ready = (page["at"] < horizon.h) | horizon.flush
            out.append(page[ready])
            self._wait(day, page[~ready])
        days = later["at"] // DAY
        for day in np.unique(days).tolist():
            page = later[days == day]
            if day in self.queue:
                page = np.concatenate((np.frombuffer(bytes(self.waiting.getValue((day,))[0]), _SALE), page))
            self._wait(day, page)
        return np.concatenate(out)

    def _wait(self, day: int, page: np.ndarray) -> None:
        if len(page):
            self.waiting.updateValue((day,), (page.tobytes(),))
            self.queue[day] = len(page)
        else:
            self.waiting.removeKey((day,))
            del self.queue[day]

    def _match(self, sales: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Each sale's version: in its own page, else in the nearest earlier one that holds its client."""
        found = np.zeros(len(sales), _VERSION)
        found["client"] = NONE
        open_ = np.flatnonzero((sales["at"] != NONE) & (sales["client"] != NONE))
        days = sorted({*self.sizes, *(d for d in self.pages if len(self.pages[d]))}, reverse=True)
        for page in [*((d, None) for d in days), (KEPT, prior)]:
            if not len(open_):
                break
            day, rows = page
            near = open_[sales["at"][open_] // DAY >= day]
            if len(near):
                rows = _sorted(self._page(day)) if rows is None else rows
                place = _latest(rows, sales["client"][near], sales["at"][near])
                hit = place >= 0
                found[near[hit]] = rows[place[hit]]
                open_ = open_[found["client"][open_] == NONE]
        return found

    def _prune(self, h: int, superseded: bool) -> np.ndarray:
        """Drop versions up to H but each client's last (all, if a later one up to H lies elsewhere); the dropped rows."""
        days = [d for d in {*self.sizes, *self.pages} if d <= h // DAY]
        if h == NEVER or not any(d != KEPT for d in days) and not superseded:
            return np.zeros(0, _VERSION)
        rows = _sorted(np.concatenate([self._page(d) for d in days] or [np.zeros(0, _VERSION)]))
        past = rows["at"] <= h
        old = rows[past]
        last = np.append(old["client"][1:] != old["client"][:-1], True)[: len(old)] & (not superseded)
        for day in days:
            self._put(day, rows[~past] if day == h // DAY else rows[:0])
        self._put(KEPT, old[last])
        return old[~last]

    def _count(self, added: np.ndarray, removed: np.ndarray) -> None:
        changed = np.concatenate((added["client"], removed["client"]))
        if len(changed):
            clients, place = np.unique(np.concatenate((self.clients, changed)), return_inverse=True)
            n = np.zeros(len(clients), np.int64)
            np.add.at(n, place, np.concatenate((self.n, np.ones(len(added), np.int64), -np.ones(len(removed), np.int64))))
            self.clients, self.n = clients[n > 0], n[n > 0]

    def _held(self, clients: np.ndarray) -> np.ndarray:
        if not len(self.clients):
            return np.zeros(len(clients), np.int64)
        place = np.minimum(np.searchsorted(self.clients, clients), len(self.clients) - 1)
        return np.where(self.clients[place] == clients, self.n[place], 0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        horizon, hot = self.horizon, key[0].startswith("client")
        self.pages, self.changed, self.op_of = {}, set(), {}
        days, sizes, queue_days, queue = self.directory.get() or ([], [], [], [])
        self.sizes, self.queue = dict(zip(days, sizes, strict=True)), dict(zip(queue_days, queue, strict=True))
        self.clients, self.n = (np.frombuffer(bytes(x), np.int64) for x in self.counts.get() or (b"", b""))

        got = pd.concat(list(rows), ignore_index=True)
        new = np.zeros(len(got), _VERSION)
        for c in ("client", "at", "id", "cents"):
            new[c] = got[c].to_numpy()
        codes, ops = pd.factorize(got["op"])
        new["op"] = np.array([self._op(x) for x in ops] + [-1], np.int32)[codes]
        kind = got["kind"].to_numpy()

        come = new[kind == VERSION]
        late = come["at"] < horizon.changes
        added = come[~late & (come["client"] != NONE)]
        for day in np.unique(added["at"] // DAY).tolist():
            self._put(day, np.concatenate((self._page(day), added[added["at"] // DAY == day])))
        self._count(added, added[:0])

        sales = np.zeros(int((kind == SALE).sum()), _SALE)
        for c in _SALE.names:
            sales[c] = new[c][kind == SALE]
        due = self._take(horizon, sales)
        tick = new[kind == TICK]
        if hot:  # the neighbours' versions count too: the tick tells how many there are, and when the next one holds
            held = np.full(len(due), tick["id"].max(initial=0))
            superseded = bool((tick["at"] <= horizon.h).any())
        else:
            held, superseded = self._held(due["client"]), False
        found = self._match(due, _sorted(new[kind == PRIOR]))
        if not horizon.flush:
            self._count(added[:0], self._prune(horizon.h, superseded))
        self._write()
        self.directory.update(([*self.sizes], [*self.sizes.values()], [*self.queue], [*self.queue.values()]))
        self.counts.update((self.clients.tobytes(), self.n.tobytes()))
        names = np.array([*self.op_of, None], dtype=object)
        yield _out("late", come[late]["id"], horizon.batch)
        yield _out("sale", due["id"], horizon.batch, held, found, names)
        if hot and (self.sizes or self.queue):
            mine = _sorted(np.concatenate([self._page(d) for d in self.sizes] or [np.zeros(0, _VERSION)]))
            names = np.array([*self.op_of, None], dtype=object)  # reading those pages may have added some
            client, part = key[0].removeprefix("client ").split("/")
            page = _out("page", np.array([int(client)]), horizon.batch, np.array([len(mine)]), mine[-1:] if len(mine) else np.full(1, NONE).astype([("client", "<i8")]), names)
            yield page.assign(slice=int(part), first_at=_nullable(mine["at"][:1], 1), last_at=_nullable(mine["at"][-1:], 1), waiting=sum(self.queue.values()))


def _nullable(values: np.ndarray, n: int) -> pd.Series:
    values = np.concatenate((values, np.full(n - len(values), NONE))).astype(np.int64)
    return pd.Series(pd.arrays.IntegerArray(values, values == NONE))


def _out(rec: str, ids: np.ndarray, batch: int, held: np.ndarray | None = None, found: np.ndarray | None = None, names: np.ndarray | None = None) -> pd.DataFrame:
    n = len(ids)
    none = np.full(n, NONE)
    hit = found["client"] != NONE if found is not None else np.zeros(n, bool)
    whole = found is not None and "op" in found.dtype.names
    frame = {
        "rec": pd.Series([rec] * n, dtype=object),  # not the string type whose columns come in pieces
        "id": _nullable(ids, n),
        "n_held": _nullable(none if held is None else held.astype(np.int64), n),
        "change_id": _nullable(np.where(hit, found["id"], NONE) if whole else none, n),
        "balance_cents": _nullable(np.where(hit, found["cents"], NONE) if whole else none, n),
        "op": pd.Series(np.where(hit, names[found["op"]], None) if whole else [None] * n, dtype=object),
    }
    return pd.DataFrame(frame).assign(slice=_nullable(none, n), first_at=_nullable(none, n), last_at=_nullable(none, n), waiting=_nullable(none, n), batch=batch)


def _micros(at: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({at} AS TIMESTAMP_NTZ))")


def _batch(day: Column, first_day: int, days: int, batches: int) -> Column:
    """The batch of a day; what has none is in the last one, what lies before the first day in the first one."""
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first_day) * batches / days))).cast("int")


def _inputs(sales: DataFrame, changes: DataFrame, first_day: int, days: int, batches: int) -> DataFrame:
    none = F.lit(NONE).cast("long")
    batch = lambda day: _batch(day, first_day, days, batches).alias("batch")
    sold = sales.select(
        F.lit(SALE).alias("kind"), F.coalesce(F.col("client_id").cast("long"), none).alias("client"), F.coalesce(_micros("sold_at"), none).alias("at"),
        F.coalesce(F.col("sale_id").cast("long"), none).alias("id"), none.alias("cents"), F.lit(None).cast("string").alias("op"),
        batch(F.floor(_micros("arrived_at") / DAY)), F.coalesce(F.floor(_micros("sold_at") / DAY), F.floor(_micros("arrived_at") / DAY), F.lit(first_day)).cast("int").alias("day"),
    )
    cents = F.when(F.isnan("balance"), None).otherwise(F.floor(F.col("balance") * 100 + 0.5))
    day = F.floor(_micros("valid_at") / DAY)
    changed = changes.distinct().filter(F.col("valid_at").isNotNull()).select(
        F.lit(VERSION).alias("kind"), F.coalesce(F.col("client_id").cast("long"), none).alias("client"), _micros("valid_at").alias("at"),
        F.coalesce(F.col("change_id").cast("long"), none).alias("id"), F.coalesce(cents.cast("long"), none).alias("cents"), F.col("op"),
        batch(day + F.crc32(F.col("change_id").cast("string").cast("binary")) % 4), day.cast("int").alias("day"),
    )
    return sold.unionByName(changed)


def _neighbours(rows: DataFrame, told: DataFrame | None) -> DataFrame:
    """Rows to feed to the cells of busy clients: for each how many versions its client has, when the next cell's first
    one holds, and the last one of the cells before. ``rows``: what comes; ``told``: what the cells told last."""
    is_version = F.col("kind") == VERSION
    come = rows.select("client", "day", is_version.cast("long").alias("n"), F.when(is_version, F.col("at")).alias("first_at"), F.when(is_version, F.struct("at", "id", "cents", "op")).alias("last"))
    if told is not None:
        none = lambda c: F.coalesce(c, F.lit(NONE).cast("long"))
        kept = F.when(F.col("last_at").isNotNull(), F.struct(F.col("last_at").alias("at"), none("change_id").alias("id"), none("balance_cents").alias("cents"), F.col("op")))
        come = come.unionByName(told.select(F.col("id").alias("client"), F.col("slice").alias("day"), F.col("n_held").alias("n"), "first_at", kept.alias("last")))
    pages = come.groupBy("client", "day").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last").alias("last"))
    by_day = Window.partitionBy("client").orderBy("day")  # a row for each day of a client
    pages = pages.select(
        F.concat(F.lit("client "), F.col("client"), F.lit("/"), F.col("day")).alias("cell"), "client",
        F.sum("n").over(Window.partitionBy("client")).alias("held"),
        F.first("first_at", ignorenulls=True).over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        F.last("last", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("prior"),
    )
    none = F.lit(NONE).cast("long")
    tick = F.struct(F.lit(TICK).alias("kind"), F.coalesce("next", F.lit(EVER)).alias("at"), F.col("held").alias("id"), none.alias("cents"), F.lit(None).cast("string").alias("op"))
    prior = F.when(F.col("prior").isNotNull(), F.struct(F.lit(PRIOR).alias("kind"), *(F.col(f"prior.{c}").alias(c) for c in ("at", "id", "cents", "op"))))
    return pages.select("cell", "client", F.explode(F.array_compact(F.array(tick, prior))).alias("r")).select("cell", "r.kind", "client", "r.at", "r.id", "r.cents", "r.op")


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def enriched(sales: DataFrame, changes: DataFrame, batches: int = 10, first_day: int = 19723, days: int = 152, rows_per_cell: int = 20_000) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op): a row for each sale and each late change.

    ``sales`` (sale_id, client_id, sold_at, arrived_at) and ``changes`` (change_id, client_id, valid_at, op, balance, ...)
    are cut into ``batches`` by day, ``days`` from ``first_day``; the query is started once for each batch, and once more
    for what then waits, on one new checkpoint below spark.checkpoint.dir. Rows without an arrival come in the last
    batch, rows from before the first day in the first. Equal changes are one; a change without valid_at is ignored.
    Sales without client or sold_at are emitted with null version; without client they hold 0 versions. Versions of equal
    (valid_at, change_id) are ordered by balance, then operation. A balance that is null or NaN gives null cents. Repeated
    sales keep their rows; empty tables give no rows; other columns only tell changes apart.
    """
    spark = sales.sparkSession
    folder = f"{workspace(spark)}/valid-time-{uuid.uuid4().hex[:8]}"
    cells = max(64, -(-(sales.count() + changes.count()) // rows_per_cell))
    rows = _inputs(sales, changes, first_day, days, batches)
    busy = stage(rows.filter(F.col("client") != NONE).groupBy("client").count().filter(F.col("count") > rows_per_cell).select("client", F.lit(True).alias("busy")), "busy-clients")
    any_busy = not busy.isEmpty()
    spread = F.pmod(F.xxhash64(F.when(F.col("client") == NONE, F.col("id")).otherwise(F.col("client"))), F.lit(cells))
    cell = F.when(F.col("busy"), F.concat(F.lit("client "), F.col("client"), F.lit("/"), F.col("day"))).otherwise(F.concat(F.lit("cell "), spread))
    rows = rows.join(busy, "client", "left").withColumn("cell", cell).hint("rebalance", "batch")
    rows.write.partitionBy("batch").parquet(f"{folder}/batches")
    staged = spark.read.schema(rows.schema).parquet(f"{folder}/batches")
    largest = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("at") != NONE), F.col("at")))
    of_batch = {r[0]: (r[1], r[2]) for r in staged.groupBy("batch").agg(largest(SALE), largest(VERSION)).collect()}

    none = F.lit(NONE).cast("long")
    ticks = spark.range(cells).select(F.concat(F.lit("cell "), F.col("id")).alias("cell"), F.lit(TICK).alias("kind"), none.alias("client"), none.alias("at"), none.alias("id"), none.alias("cents"), F.lit(None).cast("string").alias("op"))
    columns = [c.split()[0] for c in _FED.split(", ")]
    feed, out, told = f"{folder}/feed", f"{folder}/out", None
    with _settings(spark):
        for horizon in horizons(of_batch, batches):
            come = staged.filter(F.col("batch") == horizon.batch)
            fed = come.select(columns).unionByName(ticks)
            if any_busy:
                counted = come.filter(F.col("busy") & ((F.col("kind") == SALE) | (F.col("at") >= horizon.changes)))
                fed = fed.unionByName(_neighbours(counted, told).select(columns))
            fed.write.mode("append").parquet(feed)
            stream = spark.readStream.schema(_FED).parquet(feed).groupBy("cell").transformWithStateInPandas(Pages(horizon), _OUT, "Append", "None")
            query = stream.writeStream.format("parquet").partitionBy("batch").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode("append").start()
            query.awaitTermination()
            if any_busy:
                told = spark.read.schema(_OUT).parquet(out).filter((F.col("batch") == horizon.batch) & (F.col("rec") == "page"))
    result = spark.read.schema(_OUT).parquet(out).filter(F.col("rec") != "page")
    return result.select("rec", "id", F.col("batch").cast("long").alias("batch"), "n_held", "change_id", "balance_cents", "op")
