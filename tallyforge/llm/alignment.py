"""Operator 12: alignment of the tokens of two tokenizers over the same bytes, with corpus-wide counts of linked ids.

Both token sequences spell the same bytes. Where tokens of both end, a group ends; where token ranges overlap, their ids
are linked. A pair of ids is one packed 64-bit key (A's id in the upper half). Each task counts the documents of its keys
with np.unique; the partial counts are sorted by ranges of keys over all tasks and summed by run length; each range is
written as one sorted shard, which lookups map into memory and search. The number of keys is bounded by the product of
the vocabularies, not by the corpus.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage, workspace
from .subwords import WordCache, ids_of, public_path, token_bytes

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts tokenised at once hold about so many characters; results leave a task when they hold so many pairs.
AT_ONCE, PAIRS_HELD = 1 << 18, 1 << 18
#: Keys that a task gathers before it unites them; distinct ones that it holds before it hands them on.
GATHERED, DISTINCT_HELD = 1 << 21, 1 << 20
#: About so many partial counts make a shard.
SHARD_ROWS = 1 << 20


class Aligner:
    """Two tokenizer files; ``align`` gives both id sequences of a text and where their tokens end, in bytes."""

    def __init__(self, a: str, b: str) -> None:
        self.file = b
        self.words = WordCache(a)
        self.bytes = token_bytes(a), token_bytes(b)
        self.lengths = tuple(np.array([len(x) for x in t], dtype=np.int64) for t in self.bytes)
        self.numbers = max(map(len, self.bytes))
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(self.numbers)], dtype=object)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none where a text is empty or one of them doesn't spell a space and the text."""
        none = np.zeros(0, dtype=np.int64)
        for text, a, b in zip(texts, self.words.ids_of([" " + t for t in texts]), ids_of(self.file, texts), strict=True):
            whole = b" " + text.encode()
            spelt = all(b"".join(map(t.__getitem__, ids)) == whole for t, ids in zip(self.bytes, (a, b), strict=True))
            yield (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) if text and spelt else (none, none)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, str]:
        """The packed key of every link in text order, and the groups written out."""
        ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.concatenate(ends)
        cuts.sort(kind="stable")  # two sorted runs: one merge
        again = cuts[1:] == cuts[:-1]
        shared = cuts[1:][again]
        cuts = cuts[np.concatenate(([True], ~again))]
        # between two neighbouring cuts lies the overlap of exactly one token of each side
        keys = (a[np.searchsorted(ends[0], cuts)] << 32) | b[np.searchsorted(ends[1], cuts)]
        groups = [np.searchsorted(shared, e) for e in ends]
        last = [np.append(g[1:] != g[:-1], True) for g in groups]
        order = np.argsort(np.concatenate((groups[0] * 2, groups[1] * 2 + 1)), kind="stable")
        marks = np.concatenate((last[0] * 1, last[1] * 2)) * self.numbers + np.concatenate((a, b))
        return keys, "".join(self.written[marks[order]].tolist())[:-1]


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _linked(docs: DataFrame, a: str | None, b: str | None) -> DataFrame:
    """One row for each document: its counts, the digest of its groups, its distinct pairs and how often each is linked."""
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    ints = pa.list_(pa.int32())
    fields = [("doc_id", kind), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("a", ints), ("b", ints), ("times", ints)]
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a or public_path(A_NAME), b or public_path(B_NAME))

        def row(ids_a: np.ndarray, ids_b: np.ndarray) -> tuple:
            if not len(ids_a):
                return 0, 0, 0, 0, "", *[np.zeros(0, dtype=np.int32)] * 3
            keys, written = tool.links(ids_a, ids_b)
            pairs, times = np.unique(keys, return_counts=True)
            n_groups = len(ids_a) + len(ids_b) - len(keys)
            return len(ids_a), len(ids_b), n_groups, len(keys), hashlib.sha256(written.encode()).hexdigest(), (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)

        try:
            for batch in batches:
                done, rows, held, texts, size = 0, [], 0, [], 0

                def out(start: int, rows: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                    columns = [batch.column("doc_id").slice(start, len(rows)).cast(kind), *(pa.array([r[i] for r in rows], arrow[i + 1].type) for i in range(5))]
                    ends = pa.array(np.cumsum([0, *(len(r[5]) for r in rows)], dtype=np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]))) for i in (5, 6, 7)]
                    return pa.RecordBatch.from_arrays(columns, schema=arrow)

                n = batch.num_rows
                for at, x in enumerate(batch.column("text")):
                    texts.append(x.as_py() or "")
                    size += len(texts[-1])
                    if size >= AT_ONCE or at == n - 1:
                        for ids in tool.encode(texts):
                            rows.append(row(*ids))
                            held += len(rows[-1][5])
                        texts, size = [], 0
                    if held >= PAIRS_HELD or rows and at == n - 1:
                        yield out(done, rows)
                        done, rows, held = done + len(rows), [], 0
        finally:  # a worker is used again for other tasks
            tool.words.known = {}

    types = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "a": "array<int>", "b": "array<int>", "times": "array<int>"}
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {t}" for c, t in types.items())]))


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    return (_flat(batch, "a") << 32) | _flat(batch, "b")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``PAIRS_HELD`` pairs, or of one document."""
    for batch in batches:
        ends = np.cumsum(batch.column("a").value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS_HELD, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _partial(linked: DataFrame) -> DataFrame:
    """(key, n): documents that hold a pair, counted by task; a task hands its counts on when it holds many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held: list[np.ndarray] = []

        def united() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([*held, np.zeros(0, dtype=np.int64)]), return_counts=True)
            both, place = np.unique(np.concatenate((keys, new)), return_inverse=True)
            total = np.zeros(len(both), dtype=np.int64)
            np.add.at(total, place, np.concatenate((counts, n)))
            return both, total

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

        for batch in _slices(batches):
            held.append(_packed(batch))
            if sum(map(len, held)) >= GATHERED:
                keys, counts = united()
                held = []
                if len(keys) >= DISTINCT_HELD:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = united()
        yield out()

    return linked.select("a", "b").mapInArrow(run, "key long, n long")


def _local(uri: str) -> str | None:
    """The path of a folder that machines mount, or None where it is reached through a file system's client."""
    at = urlparse(uri)
    return at.path if at.scheme in ("", "file") else None


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under a name that no other attempt has; readers look only for names in the shards' list."""
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "wb") as f:
            np.save(f, values)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}") as f:
        np.save(f, values)


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str) -> np.ndarray:
    """An array of the shared folder, mapped into memory; from a store that can't be mounted it is copied first."""
    if (path := _local(folder)) is not None:
        return np.load(f"{path}/{name}", mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as source, tempfile.NamedTemporaryFile(suffix=".npy") as copy:
        while block := source.read(1 << 20):
            copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")  # the mapping outlives the name


def counted_pairs(partial: DataFrame, shards: int) -> DataFrame:
    """(key, n): counts summed over all tasks, sorted; keys of one range stand in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0  # the last run may go on in the next batch
        for batch in batches:
            keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            runs, sums = keys[starts], np.add.reduceat(n, starts)
            if key is not None:
                if runs[0] == key:
                    sums[0] += total
                else:
                    runs, sums = np.concatenate(([key], runs)), np.concatenate(([total], sums))
            key, total = runs[-1], sums[-1]
            yield pa.RecordBatch.from_arrays([pa.array(runs[:-1]), pa.array(sums[:-1])], names=["key", "n"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(key)], pa.int64()), pa.array([int(total)], pa.int64())], names=["key", "n"])

    return partial.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, "key long, n long")


def _shards(counts: DataFrame, folder: str) -> list[tuple[int, str]]:
    """Write each partition of sorted counts as a shard and return (first key, name), in order: a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if parts:
            keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            name = uuid.uuid4().hex
            _save(folder, f"{name}.npy", np.stack((keys, n)))
            ids = keys >> 32
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            _save(folder, f"{name}.best.npy", np.stack((ids[starts], np.maximum.reduceat(n, starts))))
            yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])], pa.int64()), pa.array([name])], names=["first", "name"])

    return sorted((r["first"], r["name"]) for r in counts.mapInArrow(run, "first long, name string").collect())


@lru_cache(maxsize=4)
def _best(folder: str, names: tuple[str, ...]) -> np.ndarray:
    """For each id of A the highest count of its pairs; an id whose pairs lie in two shards has a value in both."""
    best = np.zeros(1, dtype=np.int64)
    for name in names:
        ids, n = _mapped(folder, f"{name}.best.npy")
        if ids[-1] >= len(best):
            best = np.concatenate((best, np.zeros(int(ids[-1]) + 1 - len(best), dtype=np.int64)))
        np.maximum.at(best, ids, n)
    return best


def _looked_up(linked: DataFrame, folder: str, shards: list[tuple[int, str]]) -> DataFrame:
    """The documents' rows with n_best and count_sum, by binary search in the shards."""
    kept = [f for f in linked.schema.fields if f.name not in ("a", "b", "times")]
    firsts, names = [k for k, _ in shards], tuple(n for _, n in shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(firsts, dtype=np.int64)
        best = _best(folder, names)
        for batch in _slices(batches):
            keys, times = _packed(batch), _flat(batch, "times")
            counts = np.zeros(len(keys), dtype=np.int64)
            where = np.searchsorted(first, keys, side="right") - 1
            for s in np.unique(where).tolist():
                mine = where == s
                stored = _mapped(folder, f"{names[s]}.npy")
                counts[mine] = stored[1][np.searchsorted(stored[0], keys[mine])]
            sizes = batch.column("a").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes)))

            def total(values: np.ndarray, ends: np.ndarray = ends) -> pa.Array:
                sums = np.concatenate(([0], np.cumsum(values)))
                return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())

            sums = [total(times * (counts == best[keys >> 32])), total(times * counts)] if len(keys) else [pa.array([0] * batch.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + sums, names=[*(f.name for f in kept), "n_best", "count_sum"])

    return linked.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "n_best long, count_sum long"]))


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row of ``docs`` (doc_id, text).

    ``a``, ``b``: the tokenizer files on every machine (None: the public ones). A null or empty text, and one whose tokens
    don't spell a space and the text, has zeros and an empty ``groups_sha256``. A repeated row is a document of its own; a
    null doc_id stays; an empty table gives no rows; other columns are not looked at. Of equal counts all are best.
    Whole texts are aligned; a text is tokenised once, its pairs are staged in the shared folder.
    """
    folder = f"{workspace(docs.sparkSession)}/pair-counts-{uuid.uuid4().hex[:8]}"
    linked = stage(_linked(docs, a, b), "linked-tokens")
    partial = stage(_partial(linked), "partial-counts")
    shards = _shards(counted_pairs(partial, max(1, -(-partial.count() // SHARD_ROWS))), folder)
    return _looked_up(linked, folder, shards).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
