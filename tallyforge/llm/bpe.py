"""Operator 4: BPE encoding and decoding with a public vocabulary.

A word's symbols stand in a linked list; a segment tree over the ranks of adjacent pairs keeps, in every node, the
lowest rank below it, the left child winning ties. The root so yields the leftmost lowest-rank merge; a merge changes
three leaves, each in logarithmic time, until no pair is left that merges. A word of n symbols costs O(n log n) however
long it is. Words are cached up to a bound; what a word becomes never depends on the cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

#: Words longer than this are not cached; of others two generations are, each of at most so many.
CACHED_LENGTH, CACHED_WORDS = 64, 150_000
#: Words of up to so many bytes are merged side by side, those of about so many words of text at once.
WIDEST, WORDS_AT_ONCE = 64, 150_000
#: Results are handed on when they hold so many tokens.
TOKENS_HELD = 1 << 17
_NONE = 1 << 60


class PairTree:
    """Minimum segment tree over pair ranks with point updates; the root's leaf is the leftmost of lowest rank."""

    def __init__(self, ranks: list[int]) -> None:
        self.size = 1
        while self.size < len(ranks):
            self.size *= 2
        self.low = [_NONE] * (2 * self.size)
        self.low[self.size : self.size + len(ranks)] = ranks
        low = self.low
        for i in range(self.size - 1, 0, -1):
            a, b = low[2 * i], low[2 * i + 1]
            low[i] = a if a <= b else b

    def set(self, leaf: int, rank: int) -> None:
        low, i = self.low, leaf + self.size
        low[i] = rank
        while i > 1:
            other = low[i ^ 1]
            if other < rank:
                rank = other
            i >>= 1
            if low[i] == rank:
                return
            low[i] = rank

    def best(self) -> int | None:
        """The leaf of the leftmost lowest rank, or None if no pair merges."""
        low, size, i = self.low, self.size, 1
        rank = low[1]
        if rank == _NONE:
            return None
        while i < size:
            i *= 2
            if low[i] != rank:
                i += 1
        return i - size


class Tokenizer:
    """The word-end BPE of a tokenizer file: its added tokens, normalizer, pattern, vocabulary and merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or spec["post_processor"]:
            raise ValueError("a BPE tokenizer without decoder and post-processor is expected")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pairs = np.array(sorted((a << 20) + b for a, b in self.merges), dtype=np.int64)
        self.pair_ranks = np.array([self.merges[int(p) >> 20, int(p) & 0xFFFFF][0] for p in self.pairs], dtype=np.int64)
        self.merged = np.array([new for _, new in sorted(self.merges.values())], dtype=np.int64)
        self.token = {i: t for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        specials = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # white space is Unicode's, as in the engine of the tokenizer file
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        # the same words, found faster, where all characters beyond ASCII are letters
        plain = split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\rA-Za-z0-9\x80-\U0010ffff]").replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", "[0-9]")
        self.plain = re.compile(plain)
        self.of_byte = _byte_letters()
        whole = all(x in ids and x + self.suffix in ids for x in self.of_byte)
        self.letters = np.array([ids[x] for x in self.of_byte]) if whole else None
        self.last_letters = np.array([ids[x + self.suffix] for x in self.of_byte]) if whole else None
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def forget(self) -> None:
        """Empty the cache of words: a worker that is used again for other tasks doesn't hold it."""
        self.young, self.old = {}, {}

    def merge(self, word: str) -> list[int]:
        """The ids of one word."""
        letters = [self.of_byte[b] for b in word.encode("utf-8", "replace")]
        letters[-1] += self.suffix
        ids = [self.vocab[x] for x in letters if x in self.vocab]
        n = len(ids)
        if n < 2:
            return ids
        get, after, prior = self.merges.get, [*range(1, n), -1], [-1, *range(n - 1)]
        none = (_NONE, 0)
        tree = PairTree([get(pair, none)[0] for pair in zip(ids, ids[1:], strict=False)] + [_NONE])
        while (i := tree.best()) is not None:
            j = after[i]
            ids[i] = new = get((ids[i], ids[j]))[1]
            ids[j] = -1
            after[i] = k = after[j]
            tree.set(j, _NONE)
            if k >= 0:
                prior[k] = i
                tree.set(i, get((new, ids[k]), none)[0])
            else:
                tree.set(i, _NONE)
            if (h := prior[i]) >= 0:
                tree.set(h, get((ids[h], new), none)[0])
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """The ids of many words: the same segment tree as in ``merge``, one for each word, stepped side by side."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        raw = [w.encode("utf-8", "replace") for w in words]
        for at, b in enumerate(raw):
            by_size.setdefault(1 << max(1, (len(b) - 1).bit_length()), []).append(at)
        for size, places in by_size.items():
            if size > WIDEST or self.letters is None:
                for at in places:
                    out[at] = self.merge(words[at])
            else:
                for at, ids in zip(places, self._side_by_side([raw[x] for x in places], size), strict=True):
                    out[at] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a << 20) + b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], _NONE)

    def _side_by_side(self, raw: list[bytes], size: int) -> list[list[int]]:
        n, width = len(raw), size + 1  # the last place stands for none
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=n)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = np.full((n, width), -1, dtype=np.int64)
        ids[np.arange(width)[None, :] < lengths[:, None]] = self.letters[data]
        ids[np.arange(n), lengths - 1] = self.last_letters[data[np.cumsum(lengths) - 1]]
        after = np.minimum(np.arange(1, width + 1), size)[None, :].repeat(n, axis=0)
        after[np.arange(n), lengths - 1] = size
        prior = np.arange(-1, width - 1)[None, :].repeat(n, axis=0)
        prior[:, 0] = size
        low = np.full((n, 2 * size), _NONE, dtype=np.int64)
        low[:, size : 2 * size - 1] = self._rank(ids[:, : size - 1], ids[:, 1:size])
        level = size // 2
        while level:
            low[:, level : 2 * level] = np.minimum(low[:, 2 * level : 4 * level : 2], low[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        ids_, after_, prior_, low_ = ids.ravel(), after.ravel(), prior.ravel(), low.ravel()
        rows = np.arange(n)
        while True:
            rank = low_[rows * 2 * size + 1]
            open_ = rank != _NONE
            rows, rank = rows[open_], rank[open_]
            if not len(rows):
                break
            node, base, tree = np.ones_like(rows), rows * width, rows * 2 * size
            while node[0] < size:
                node *= 2
                node += low_[tree + node] != rank
            i = node - size
            j = after_[base + i]
            k, h, new = after_[base + j], prior_[base + i], self.merged[rank]
            ids_[base + i] = new
            ids_[base + j] = -1
            after_[base + i] = k
            prior_[base + k] = i
            first = h == size  # nothing stands before: the leaf of j is set again
            leaves = np.concatenate([j, i, np.where(first, j, h)]) + size
            ranks = np.concatenate([np.full(len(rows), _NONE), self._rank(new, ids_[base + k]), np.where(first, _NONE, self._rank(ids_[base + h], new))])
            trees = np.concatenate([tree, tree, tree])
            low_[trees + leaves] = ranks
            while leaves[0] > 1:
                leaves >>= 1
                child = trees + 2 * leaves
                low_[trees + leaves] = np.minimum(low_[child], low_[child + 1])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def words(self, text: str) -> list[str]:
        """The words and added tokens of a whole text in order."""
        out: list[str] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                # each character by itself: no context-dependent final sigma
                lower = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                plain = lower.isascii() or all(c.isalpha() or c < "\x80" for c in set(lower))
                out += (self.plain if plain else self.pattern).findall(lower)
        return out

    def _known(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """The ids of words and their strings, both joined by spaces."""
        known, missing = {}, []
        for w in words:
            found = self.young.get(w)
            if found is None:
                if (found := self.old.get(w)) is None:
                    if w in self.added:
                        known[w] = str(self.added[w]), w
                    else:
                        missing.append(w)
                    continue
                self._keep(w, found)
            known[w] = found
        token = self.token
        for w, ids in zip(missing, self.merge_many(missing), strict=True):
            known[w] = found = " ".join(map(str, ids)), " ".join([token[i] for i in ids])
            self._keep(w, found)
        return known

    def _keep(self, word: str, found: tuple[str, str]) -> None:
        if len(word) <= CACHED_LENGTH:
            if len(self.young) >= CACHED_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found

    def run(self, texts: Iterable[str | None]) -> Iterator[tuple[str, str]]:
        """For each whole text its ids and what they decode to, both joined by spaces."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.words(text or ""))
            size += len(held[-1])
            if size >= WORDS_AT_ONCE:
                yield from self._finish(held)
                held, size = [], 0
        yield from self._finish(held)

    def _finish(self, held: list[list[str]]) -> Iterator[tuple[str, str]]:
        known = self._known(set().union(*held))
        for words in held:
            pieces = [p for w in words if (p := known[w])[0]]
            yield " ".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.run([text]) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: what decoding is where a tokenizer file names no decoder."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def _byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(free)) for b in range(256)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_path() -> str:
    """The public vocabulary's file on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs`` (doc_id, text), with ``ids`` on request.

    ``path`` is the tokenizer file on every executor (None: the installed public one). Null and empty texts have no
    tokens; repeated rows are encoded each; an empty table gives no rows; other columns are not looked at. Whole texts
    are encoded in one task each. Results leave a task as soon as they hold ``TOKENS_HELD`` tokens, ids as 32-bit
    integers, so memory follows that bound and the longest text, not the number of rows in a batch.
    """
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    fields = [("doc_id", kind), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    arrow = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or default_path())
        for b in batches:
            start, rows, arrays, held = 0, [], [], 0

            def out(start=0, rows=(), arrays=(), b=b):
                columns = [b.column("doc_id").slice(start, len(rows)).cast(kind), *([r[i] for r in rows] for i in range(3))]
                if with_ids:
                    ends = np.cumsum([0, *(len(a) for a in arrays)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays))))
                return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

            for ids, decoded in t.run(x.as_py() for x in b.column("text")):
                n = ids.count(" ") + bool(ids)
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                if with_ids:
                    arrays.append(np.array(ids.split(), dtype=np.int32))
                held += n
                if held >= TOKENS_HELD:
                    yield out(start, rows, arrays)
                    start, rows, arrays, held = start + len(rows), [], [], 0
            if rows:
                yield out(start, rows, arrays)
        t.forget()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
