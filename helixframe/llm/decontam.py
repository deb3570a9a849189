"""Benchmark decontamination: a prefix-filtered join of documents with the word windows of benchmark items.

A window is ``window`` consecutive words of an item (all of a shorter one). Its tokens are word shingles, ordered by how
rare they are in the whole corpus. Containment of a window needs every one of its shingles, so its necessary prefix is
one: the rarest. Documents meet windows on that shingle only; its offset fixes where the window would have to stand,
length and position bounds drop what sticks out of the text, and the words themselves are compared.

Items are taken in blocks of ``block_words`` words, and an item of more in overlapping parts, so an index has a bounded size
whatever the benchmark has. Each block is held against all documents before the next but one is read, and then released.
Nothing of the documents is shuffled unless there are several blocks.

Null or wordless texts hit nothing; items without id or words are ignored; items of one id count as one; repeated rows
each get their own result row; an empty benchmark contaminates nothing, and an empty table of documents gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._common import materialise
from helixframe.llm._text import ALNUM, Words, left, shingles, slices, text_words, words

_BITS = 20


class _Index:
    """Windows of one block of items; probes by shingle once ``choose`` knows how frequent shingles are."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        w = text_words([t for _, t in items], ALNUM)
        of: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for i, (name, _) in enumerate(items):
            ws = [w.word(j) for j in range(w.first[i], w.first[i + 1])]
            for j in range(max(1, len(ws) - window + 1) if ws else 0):
                of[tuple(ws[j : j + window])].add(name)
        self.windows = list(of)
        self.items = [sorted(of[x]) for x in self.windows]
        flat = text_words([b" ".join(x).decode("utf-8", "surrogateescape") for x in self.windows], ALNUM)
        self.length = flat.counts()
        self.tokens = []  # per window: shingle length, hashes by offset
        by = {m: shingles(flat, m) for m in {min(shingle, n) for n in self.length.tolist()}}
        for i, n in enumerate(self.length.tolist()):
            m, a = min(shingle, n), flat.first[i]
            self.tokens.append((m, by[m][a : a + n - m + 1]))
        self.vocabulary = {m: np.unique(np.concatenate([h for k, h in self.tokens if k == m])) for m in by}
        self.probes: dict[int, _Keys] = {}

    def choose(self, counts: dict[int, int]) -> None:
        """Takes each window's rarest shingle as its prefix; ties by hash."""
        found = defaultdict(list)
        for i, (m, hashes) in enumerate(self.tokens):
            at = min(range(len(hashes)), key=lambda o: (counts.get(int(hashes[o]), 0), int(hashes[o])))
            found[m].append((int(hashes[at]), i, at))
        for m, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            self.probes[m] = _Keys(*np.unique(keys, return_index=True), np.array([r[1:] for r in rows], np.int64))
        self.tokens = self.vocabulary = None


class _Keys:
    def __init__(self, keys: np.ndarray, first: np.ndarray, rows: np.ndarray):
        self.keys, self.first, self.rows = keys, np.append(first, len(rows)), rows
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[keys >> np.uint64(64 - _BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are keys, and which."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _BITS)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def _places(w: Words, index: _Index) -> list[tuple[int, int, int]]:
    """Text, first word (in w) and window of each occurrence."""
    out, rest, owner = [], left(w), w.text()
    for m, keys in index.probes.items():
        at, key = keys.find(shingles(w, m))
        ok = rest[at] >= m
        at, key = at[ok], key[ok]
        n = keys.first[key + 1] - keys.first[key]
        row = np.repeat(keys.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, (win, offset) = np.repeat(at, n), keys.rows[row].T
        begin, size = at - offset, index.length[win]
        fits = (begin >= w.first[owner[at]]) & (size <= rest[at] + offset)
        for i, b, x in zip(owner[at][fits].tolist(), begin[fits].tolist(), win[fits].tolist(), strict=True):
            if all(w.word(b + t) == v for t, v in enumerate(index.windows[x])):
                out.append((i, b, x))
    return out


def _hits(texts: pa.Array, index: _Index) -> Iterator[tuple[int, int, dict[int, tuple[list[tuple[int, int]], set[str]]]]]:
    """Per text that has any: word intervals hit and items, for slices of texts with their word counts."""
    for a, b, buf, offsets in slices(texts):
        w = words(buf, offsets, ALNUM)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for i, begin, x in _places(w, index):
            spans, items = found.setdefault(i, ([], set()))
            p = int(begin - w.first[i])
            spans.append((p, p + int(index.length[x])))
            items.update(index.items[x])
        yield a, w.counts(), found


def _covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _sha(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _parts(name: str, text: str, window: int, most: int) -> Iterator[tuple[str, str, int]]:
    """An item of more than most words in parts that overlap, so that they have its windows: name, text, words about."""
    about = text.count(" ") + 1
    w = text_words([text], ALNUM) if len(text) > most else None
    n = len(w.hash) if w else 0
    if n <= most + window:
        yield name, text, about
        return
    for j in range(0, n - window + 1, most):
        part = b" ".join(w.word(i) for i in range(j, min(n, j + most + window - 1)))
        yield name, part.decode("utf-8", "surrogateescape"), most


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        for name, text, about in _parts(r.i, r.t, window, block_words):
            block.append((name, text))
            size += about
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def _indexes(docs: DataFrame, items: DataFrame, window: int, shingle: int, block_words: int) -> Iterator:
    """A broadcast index for each block of items."""
    sc = docs.sparkSession.sparkContext
    for block in _blocks(items, window, block_words):
        index = _Index(block, window, shingle)
        if not index.windows:
            continue
        vocabulary = sc.broadcast({m: _Keys(v, np.arange(len(v)), v) for m, v in index.vocabulary.items()})

        def count(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            totals = {m: np.zeros(len(k.keys), np.int64) for m, k in vocabulary.value.items()}
            for batch in batches:
                for _, _, buf, offsets in slices(batch.column(0)):
                    w = words(buf, offsets, ALNUM)
                    rest = left(w)
                    for m, keys in vocabulary.value.items():
                        at, key = keys.find(shingles(w, m))
                        totals[m] += np.bincount(key[rest[at] >= m], minlength=len(keys.keys))
            for m, n in totals.items():
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(vocabulary.value[m].keys[some].view(np.int64)), pa.array(n[some])], ["h", "n"])

        counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        index.choose({r.h % 2**64: r.n for r in counts.collect()})  # the vocabulary of a block at most
        vocabulary.unpersist()
        yield sc.broadcast(index)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 1_000_000) -> DataFrame:
    """Per document (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated."""
    every = _indexes(docs, items, window, shingle, block_words)
    indexes = list(itertools.islice(every, 2))  # one is the usual case; of several, two are held at a time
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if len(indexes) <= 1:

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for _, counts, found in _hits(batch.column(1), indexes[0].value) if indexes else _counts(batch.column(1)):
                    for i, n in enumerate(counts.tolist()):
                        spans, items = found.get(i, ([], set()))
                        rows.append((n, _covered(spans), len(items), _sha(items), bool(spans)))
                yield _batch(batch.column(0), rows, names)

        return docs.select("doc_id", "text").mapInArrow(one, schema)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = []
    for index in itertools.chain(indexes, every):

        def some(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, spans, items = [], [], []
                for a, _, hit in _hits(batch.column(1), index.value):
                    for i, (s, x) in hit.items():
                        at.append(a + i)
                        spans.append([v for p in s for v in p])
                        items.append(sorted(x))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), batch.column(2).take(pa.array(at, pa.int32())), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "th", "spans", "items"])

        found.append(materialise(keyed.mapInArrow(some, f"doc_id {kind}, th long, spans array<long>, items array<string>")))
        index.unpersist()
    hit = found[0]
    for more in found[1:]:
        hit = hit.union(more)
    hit = hit.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(c) for _, counts, _ in _counts(batch.column(1)) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "th", "n_words"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, s, x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                items, s = set(x or ()), s or []
                rows.append((n, _covered(list(zip(s[::2], s[1::2], strict=True))), len(items), _sha(items), bool(s)))
            yield _batch(batch.column(0), rows, names)

    base = keyed.mapInArrow(totals, f"doc_id {kind}, th long, n_words long").alias("b")
    joined = base.join(hit.alias("h"), F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("b.th") == F.col("h.th")), "left")
    return joined.select("b.doc_id", "n_words", "spans", "items").mapInArrow(merge, schema)


def _counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, dict]]:
    for a, _, buf, offsets in slices(texts):
        yield a, words(buf, offsets, ALNUM).counts(), {}


def _batch(ids: pa.Array, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in names[1:]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 1_000_000) -> DataFrame:
    """docs, all columns, without those that hold a window of an item."""
    at = docs.columns.index("text")
    before = None
    for index in _indexes(docs, items, window, shingle, block_words):
        if before is not None:
            docs = materialise(docs)
            before.unpersist()

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for a, _, found in _hits(batch.column(at), index.value):
                    ok[[a + i for i in found]] = False
                yield batch.filter(pa.array(ok))

        docs, before = docs.mapInArrow(keep, docs.schema), index
    return docs
