"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words, hashed into 2^bits buckets with log-scaled, normalised counts, its structure
statistics (shares of letters, capitals, digits, marks, repeats, distinct words, line and word lengths) as values and as
bins, and the size of its text as metadata. The score is the logistic of ``w0 + sum w_i x_i + sum_i<j <v_i, v_j> x_i x_j``;
the pairwise part is computed as ``0.5 * sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)``, linear in the features that occur.

Null and empty texts have only the structure of an empty text and are scored by that. Repeated rows get equal scores.
Without training rows of both classes every score is the share of label 1 (0.5 without any). Texts are read whole however
long, in time linear in their length. Ties of score stay ties; where more labelled rows exist than are fitted, those of the
smallest hash of the id are, ties by id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._labels import remainder, training_rows
from helixframe.llm._text import SPACED, slices, words

BINS = 10
STATS = ("capitals", "digits", "marks", "bars", "bangs", "symbols", "not_ascii", "spaces", "lines", "word_length", "adjacent_repeats", "distinct", "top_word", "repeated_shingles", "size", "words")


def _classes() -> np.ndarray:
    """Byte class by structure statistic 0..8, 15 for the rest."""
    c = np.full(256, 15, np.uint8)
    c[65:91], c[48:58], c[128:] = 0, 1, 6
    for marks, k in ((b".,;:'\"()?-", 2), (b"|", 3), (b"!", 4), (b"#$%&*@^~_=+<>{}[]\\/`", 5), (b" \t\r", 7), (b"\n", 8)):
        c[np.frombuffer(marks, np.uint8)] = k
    return c


_CLASS = _classes()


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: first feature of each text, feature ids, values."""
    texts = len(offsets) - 1
    w = words(buf, offsets, SPACED)
    n, owner, size = w.counts(), w.text(), np.maximum(np.diff(offsets), 1)
    sums = np.zeros((texts, 16))
    byte_owner = np.repeat(np.arange(texts), np.diff(offsets))
    sums[:] = np.bincount(byte_owner * 16 + _CLASS[buf], minlength=texts * 16).reshape(texts, 16)
    stats = np.zeros((texts, len(STATS)))
    stats[:, :9] = np.sqrt(sums[:, :9] / size[:, None])
    some = np.maximum(n, 1)
    stats[:, 9] = np.minimum(size / some / 20, 1)
    again = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    stats[:, 10] = np.bincount(owner[1:][again], minlength=texts) / some
    bucket = (w.hash >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique((owner.astype(np.int64) << bits) | bucket, return_counts=True)
    who, bucket = key >> bits, key & ((1 << bits) - 1)
    stats[:, 11] = np.bincount(who, minlength=texts) / some
    np.maximum.at(stats[:, 12], who, count / some[who])
    if len(w.hash) > 3:
        pair = (w.hash[:-2] * np.uint64(3) + w.hash[1:-1] * np.uint64(5) + w.hash[2:] * np.uint64(7))[owner[2:] == owner[:-2]]
        whose = owner[2:][owner[2:] == owner[:-2]]
        order = np.lexsort((pair, whose))
        same = (pair[order][1:] == pair[order][:-1]) & (whose[order][1:] == whose[order][:-1])
        stats[:, 13] = np.bincount(whose[order][1:][same], minlength=texts) / some
    stats[:, 14], stats[:, 15] = np.log2(size) / 24, np.log2(some) / 20
    stats = np.clip(stats, 0, 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(who, value * value, minlength=texts))
    value = value / np.maximum(norm[who], 1e-9)
    base, m = 1 << bits, len(STATS)
    binned = base + m + np.arange(m) * BINS + np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    extra_id = np.hstack([np.broadcast_to(base + np.arange(m), (texts, m)), binned])
    extra = np.hstack([stats, np.full((texts, m), 0.5)])
    text = np.concatenate([who, np.repeat(np.arange(texts), 2 * m)])
    order = np.argsort(text, kind="stable")
    first = np.searchsorted(text[order], np.arange(texts + 1))
    return first, np.concatenate([bucket, extra_id.ravel()])[order], np.concatenate([value, extra.ravel()])[order].astype(np.float32)


class Machine:
    """A factorisation machine with logistic output, trained by Adagrad on mini-batches."""

    def __init__(self, size: int, rank: int, seed: int = 5):
        self.w0 = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.Generator(np.random.PCG64(seed)).normal(0, 0.02, (size, rank)).astype(np.float32)

    def raw(self, first: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, first[:-1], axis=0)
        linear = np.add.reduceat(self.w[ids] * x, first[:-1])
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first[:-1]))
        return self.w0 + linear + pairs, s, vx

    def probability(self, first: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(first, ids, x)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float = 0.1, ridge: float = 1e-5, batch: int = 128, seed: int = 6) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        gw, gv, g0 = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                part = order[a : a + batch]
                first = np.cumsum([0, *(len(rows[i][0]) for i in part)])
                ids, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                raw, s, vx = self.raw(first, ids, x)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                n = np.diff(first)
                each = np.repeat(g, n)[:, None] * x[:, None]
                dv = each * (np.repeat(s, n, axis=0) - vx)
                by = np.argsort(ids, kind="stable")
                at, start = np.unique(ids[by], return_index=True)
                dw = np.add.reduceat(each[by, 0], start) + ridge * self.w[at]
                dv = np.add.reduceat(dv[by], start, axis=0) + ridge * self.v[at]
                gw[at] += dw * dw
                gv[at] += dv * dv
                g0 += float(g.sum()) ** 2
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate * dv / np.sqrt(gv[at])
                self.w0 -= rate * float(g.sum()) / np.sqrt(g0)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 10_000, bits: int = 18, rank: int = 4, epochs: int = 4) -> Machine | float:
    """The machine, from at most train_rows labelled rows outside the held-out fifth; a constant if one class is missing."""
    sample = training_rows(docs, labels, "quality", remainder(5) != 0, train_rows).select("text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for _, _, buf, offsets in slices(batch.column(0)):
                first, i, x = features(buf, offsets, bits)
                for a, b in zip(first, first[1:], strict=False):
                    ids.append(i[a:b].astype("<i4").tobytes())
                    values.append(x[a:b].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["label", "ids", "x"])

    rows, y = [], []
    for r in sample.mapInArrow(measure, "label int, ids binary, x binary").orderBy(F.xxhash64("ids", "x")).toLocalIterator():
        rows.append((np.frombuffer(r.ids, "<i4"), np.frombuffer(r.x, "<f4")))
        y.append(r.label)
    y = np.array(y, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    machine = Machine((1 << bits) + len(STATS) * (1 + BINS), rank)
    machine.fit(rows, y, epochs)
    return machine


def score(docs: DataFrame, labels: DataFrame, bits: int = 18, **how) -> DataFrame:
    """Per document (doc_id, text): doc_id, score, predicted (score of 0.3 or more)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bits=bits, **how))  # 2^bits weights: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model.value, float):
                p = np.full(batch.num_rows, model.value)
            else:
                p = np.concatenate([np.zeros(0), *(model.value.probability(*features(buf, offsets, bits)) for _, _, buf, offsets in slices(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
