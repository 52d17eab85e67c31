"""Operator 9: language ID by a byte convolutional network.

Bytes are embedded, filters of several widths run over a fixed-length window, each keeps its maximum, and a softmax over
those names the language. The network is trained in numpy on a bounded sample of labelled texts (``SAMPLE`` of
them, ``EXCERPTS`` excerpts of each), and applied to all windows of whole texts in batches; a text's probabilities are the means
over its windows, weighted by their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, BATCH = 128, 256
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 16, 8
#: The bound of the training sample: so many texts, of each at most so many excerpts of WINDOW characters, spread evenly
#: over the whole text.
SAMPLE, EXCERPTS = 6000, 4
STEPS, RATE, SEED = 700, 0.01, 11
#: Below this score the pipeline rejects a document: near what chance gives, since very short clean texts score low too.
MIN_SCORE = 0.3


class Network:
    """Embedding, convolutions with ReLU, maximum over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        f = np.float32
        self.p = {"e": rng.normal(0, 0.5, (257, DEPTH)).astype(f)}
        self.p["e"][256] = 0  # what stands beyond a window's end
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * DEPTH)) ** 0.5, (w * DEPTH, FILTERS)).astype(f)
            self.p[f"b{w}"] = np.zeros(FILTERS, f)
        self.p["v"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(f)
        self.p["c"] = np.zeros(len(classes), f)

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        n, length, d = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * d), (s[0], s[1], s[2])).reshape(n * (length - w + 1), w * d)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        x = self.p["e"][windows]
        kept, tops = [], []
        for w in WIDTHS:
            cols = self._columns(x, w)
            z = (cols @ self.p[f"w{w}"]).reshape(len(x), -1, FILTERS)
            top = z.max(axis=1) + self.p[f"b{w}"]
            kept.append((cols, z))
            tops.append(np.maximum(top, 0))
        h = np.concatenate(tops, axis=1)
        logits = h @ self.p["v"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), [x, kept, h]

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the cross-entropy, classes weighing alike."""
        rng = np.random.default_rng(SEED)
        weight = len(labels) / np.maximum(1, np.bincount(labels, minlength=len(self.classes))) / len(self.classes)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(windows), min(BATCH, len(windows)))
            xs, ys = windows[pick], labels[pick]
            probs, (x, kept, h) = self.forward(xs)
            g = probs.copy()
            g[np.arange(len(ys)), ys] -= 1
            g *= (weight[ys] / len(ys))[:, None].astype(np.float32)
            grads = {"v": h.T @ g, "c": g.sum(axis=0), "e": np.zeros_like(self.p["e"])}
            gh = (g @ self.p["v"].T) * (h > 0)
            gx = np.zeros_like(x)
            for i, w in enumerate(WIDTHS):
                cols, z = kept[i]
                part = gh[:, i * FILTERS : (i + 1) * FILTERS]
                at = z.argmax(axis=1)  # a filter's gradient goes to the place of its maximum
                cols3 = cols.reshape(len(x), -1, w * DEPTH)
                chosen = cols3[np.arange(len(x))[:, None], at]
                grads[f"w{w}"] = np.einsum("nfk,nf->kf", chosen, part)
                grads[f"b{w}"] = part.sum(axis=0)
                back = part[:, :, None] * self.p[f"w{w}"].T[None]
                for j in range(w):
                    np.add.at(gx, (np.arange(len(x))[:, None], at + j), back[:, :, j * DEPTH : (j + 1) * DEPTH])
            np.add.at(grads["e"], xs, gx)
            grads["e"][256] = 0
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, a in self.p.items():
                m[k] += 0.1 * (grads[k] - m[k])
                v[k] += 0.001 * (grads[k] ** 2 - v[k])
                a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with 256."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, 256, dtype=np.int16)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def learnable(doc_id: Column) -> Column:
    """True for documents that may be learnt from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from the learnable documents with a language; None if there are none.

    Every language of those documents is a class: each has the same share of ``sample``, and of its texts those with the
    least hashes are learnt. Only texts whose hash lies in the share of their language that is expected to hold them are
    sorted.
    """
    known = docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    draw = F.xxhash64(F.lit(SEED), "doc_id", "text")
    room = F.greatest(F.lit(0), F.length("text") - WINDOW)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(EXCERPTS - 1)), lambda j: F.floor(j * room / (EXCERPTS - 1)).cast("int") + 1))
    excerpts = F.transform(starts, lambda s: F.substr("text", s, F.lit(WINDOW)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, (1.2 * each + 100) / n)) for k, n in sizes.items()], "of string, share double")
    uniform = F.shiftrightunsigned("draw", 11).cast("double") / F.lit(float(1 << 53))
    rows = known.select("lang", excerpts.alias("text"), draw.alias("draw"))
    rows = rows.join(F.broadcast(shares), F.col("lang") == F.col("of")).filter(uniform < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    found = rows.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "text", "draw").collect()
    found.sort(key=lambda r: (r["draw"], r["lang"], r["text"]))
    classes = sorted({r["lang"] for r in found})
    windows, labels = [], []
    for r in found:
        w = np.concatenate([windows_of(t.encode("utf-8", "replace")) for t in r["text"]])
        windows.append(w)
        labels += [classes.index(r["lang"])] * len(w)
    net = Network(classes)
    net.train(np.concatenate(windows), np.array(labels))
    return net


def _letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each whole text."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if net is None:
        return out
    places = [i for i, t in enumerate(texts) if t and _letters(t)]
    sums = np.zeros((len(texts), len(net.classes)))
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        w = np.concatenate(held)
        for i in range(0, len(w), BATCH):
            part = w[i : i + BATCH]
            probs, _ = net.forward(part)
            np.add.at(sums, np.array(owner[i : i + BATCH]), probs * (part < 256).sum(axis=1, keepdims=True))
        held.clear()
        owner.clear()

    for i in places:
        w = windows_of(texts[i].encode("utf-8", "replace"))
        held.append(w)
        owner += [i] * len(w)
        if len(owner) >= 8 * BATCH:
            flush()
    if owner:
        flush()
    for i in places:
        at = int(sums[i].argmax())
        out[i] = net.classes[at], float(sums[i, at] / sums[i].sum())
    return out


def identified(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0, as is everything where no document may be learnt
    from; a null doc_id counts as held out; repeated rows get the same answer; an empty table gives no rows; other
    columns are not looked at. Of equal best scores the language first in code points is named; all windows of a text
    count, however long it is. The trained network (under 100 KB) goes to the executors with the task.
    """
    net = net or fit(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = predict(net, [t if isinstance(t, str) else None for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x for x, _ in found], "score": [y for _, y in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(~learnable(F.col("doc_id")), F.lit(True)).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE, net: Network | None = None) -> DataFrame:
    """The rows of ``docs`` whose language the network names with at least ``min_score``; all columns stay as they are."""
    net = net or fit(docs)
    names = docs.columns

    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        found = predict(net, [t if isinstance(t, str) else None for t in text])
        return pd.Series([x != "und" and y >= min_score for x, y in found], dtype=bool)

    return docs.filter(keep(F.col("text"))).select(*(F.col(f"`{c}`") for c in names))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
