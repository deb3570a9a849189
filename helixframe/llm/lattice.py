"""Language-model scoring with a subword lattice.

Pieces and their scores come from an existing vocabulary (``piece_bpe_32k.model``). Its scores are merge ranks, read as
Zipf probabilities. Every segmentation of a word into pieces is a path of a lattice over the word's bytes; byte pieces
make sure there is one. A forward recursion in log space sums the paths, a backward one gives expected piece counts, and
expectation-maximisation rounds over all training words adapt the piece probabilities. Pieces don't cross words, so a
text's marginal probability, the score, is the product over its words and the end piece.

``word_arcs`` (off) gives each word seen in training one arc more, its relative frequency, which ``lam = 1 - n1 / N`` (the
Good-Turing mass of seen words) weighs against the lattice: likelier texts, but no longer a score of the pieces alone.

Word counts are gathered from all training documents and joined, word by word, with the words of all documents. Words with
at least 1/100,000 of all tokens, so 100,000 at most, are scored where they are read; only rarer ones are shuffled, and what
one of those has beyond a fair partition adaptive execution splits.

Null and empty texts are the end token alone. Repeated rows get equal scores, and so do equal texts (ties). Very long texts
are read a slice at a time; a word longer than 64 bytes goes over a trie. Without training documents N and V are 0 and the
piece probabilities are the vocabulary's. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.llm._common import materialise
from helixframe.llm._labels import remainder
from helixframe.llm._text import SPACED, Words, distinct, distinct_by_text, gather, mix, slices, text_words, words

_MARK = "▁".encode()
_MUL = np.uint64(0xD6E8FEB86659FD93)
_BITS, _LONG, _HOT = 20, 64, 100_000


@functools.cache
def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray, int]:
    """Pieces within words, byte pieces first (0..255), the end piece last; log probabilities; longest piece."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces, rank = [bytes([b]) for b in range(256)], []
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            p = sp.id_to_piece(i).encode()
            if p and _MARK not in p[1:]:
                pieces.append(p)
                rank.append(-sp.get_score(i))
    zipf = 1 / (np.array(rank) - min(rank) + 3)
    weight = np.concatenate([np.full(256, zipf.min() / 16), zipf, [zipf.max() / 4]])
    return pieces, np.log(weight / weight.sum()), max(map(len, pieces))


class Lattice:
    """Forward and backward sums over the segmentations of words."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp, self.longest = pieces, logp, max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces[256:]], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order + 256
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[mix(self.keys) >> np.uint64(64 - _BITS)] = True
        self._trie: dict | None = None

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_MUL) + b + 1) % 2**64
        return h

    def _arcs(self, text: np.ndarray) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
        """By end: piece length, rows and piece ids."""
        n, size = text.shape
        plain, h = text.astype(np.uint64) + np.uint64(1), np.zeros((n, size), np.uint64)
        arcs: dict[int, list] = defaultdict(list)
        for m in range(1, min(size, self.longest) + 1):
            h = h[:, : size - m + 1] * _MUL + plain[:, m - 1 :]
            row, i = np.nonzero(self.seen[mix(h) >> np.uint64(64 - _BITS)])
            if not len(row):
                continue
            x = h[row, i]
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            ok = self.keys[at] == x
            row, i, piece = row[ok], i[ok], self.ids[at[ok]]
            by = np.argsort(i, kind="stable")
            row, i, piece = row[by], i[by], piece[by]
            for s, a, b in zip(*_runs(i), strict=True):
                arcs[s + m].append((m, row[a:b], piece[a:b]))
        return arcs

    def matrix(self, text: np.ndarray, count: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of words of one length (rows of bytes); adds expected piece counts."""
        n, size = text.shape
        arcs = self._arcs(text)
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            alpha[j] = alpha[j - 1] + self.logp[text[:, j - 1]]
            for m, row, piece in arcs.get(j, ()):
                alpha[j, row] = np.logaddexp(alpha[j, row], alpha[j - m, row] + self.logp[piece])
        total = alpha[size]
        if expected is not None:
            beta = np.full((size + 1, n), -np.inf)
            beta[size] = 0
            for j in range(size, 0, -1):
                byte = text[:, j - 1]
                beta[j - 1] = np.logaddexp(beta[j - 1], beta[j] + self.logp[byte])
                expected += np.bincount(byte, np.exp(alpha[j - 1] + self.logp[byte] + beta[j] - total) * count, len(expected))
                for m, row, piece in arcs.get(j, ()):
                    arc = self.logp[piece] + beta[j, row]
                    beta[j - m, row] = np.logaddexp(beta[j - m, row], arc)
                    expected += np.bincount(piece, np.exp(alpha[j - m, row] + arc - total[row]) * count[row], len(expected))
        return total

    def one(self, word: bytes, count: float = 0, expected: np.ndarray | None = None) -> float:
        """The same for one long word, over a trie."""
        if self._trie is None:
            self._trie = {}
            for i, p in enumerate(self.pieces[256:], 256):
                node = self._trie
                for b in p:
                    node = node.setdefault(b, {})
                node[-1] = i
        size, logp = len(word), self.logp.tolist()
        alpha, arcs = [-np.inf] * (size + 1), []
        alpha[0] = 0.0
        for i in range(size):
            found, node, j = [(i + 1, word[i])], self._trie, i
            while j < size and (node := node.get(word[j])) is not None:
                j += 1
                if -1 in node:
                    found.append((j, node[-1]))
            for j, piece in found:
                x, y = alpha[j], alpha[i] + logp[piece]
                alpha[j] = max(x, y) + np.log1p(np.exp(-abs(x - y))) if x > -np.inf else y
            arcs.append(found if expected is not None else None)
        if expected is not None:
            beta = [-np.inf] * (size + 1)
            beta[size] = 0.0
            for i in range(size - 1, -1, -1):
                for j, piece in arcs[i]:
                    x, y = beta[i], logp[piece] + beta[j]
                    beta[i] = max(x, y) + np.log1p(np.exp(-abs(x - y))) if x > -np.inf else y
                    expected[piece] += count * np.exp(alpha[i] + y - alpha[size])
        return alpha[size]

    def score(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word low[start:end]."""
        out, size = np.zeros(len(start)), end - start
        for m, a, b in zip(*_runs(np.sort(size)), strict=True):
            at = np.argsort(size, kind="stable")[a:b] if m <= _LONG else np.flatnonzero(size == m)
            if m > _LONG:
                for i in at.tolist():
                    out[i] = self.one(_MARK + low[start[i] : end[i]].tobytes(), 0 if count is None else count[i], expected)
                continue
            for part in np.array_split(at, -(-len(at) * (m + 3) // (1 << 20)) or 1):
                text = np.empty((len(part), m + 3), np.uint8)
                text[:, :3] = np.frombuffer(_MARK, np.uint8)
                text[:, 3:] = low[start[part][:, None] + np.arange(m)]
                out[part] = self.matrix(text, None if count is None else count[part], expected)
        return out


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """Values of a sorted array, where their runs begin and end."""
    if not len(x):
        return [], [], []
    cut = np.flatnonzero(np.diff(x)) + 1
    first = np.concatenate([[0], cut])
    return x[first].tolist(), first.tolist(), [*cut.tolist(), len(x)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of slices of texts with their occurrences in training documents."""
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, buf, offsets in slices(batch.column(0), 1 << 21):
            w = words(buf, offsets, SPACED)
            first, inverse, _ = distinct(w)
            c = np.bincount(inverse, train[a:b][w.text()], len(first)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([gather(w.low, w.start[first], w.end[first]), pa.array(c)], ["word", "c"])


def _buffered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            parts, n = [], 0
    if n:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _each_word(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Words that are given one by one, as texts."""
    for a, b, buf, offsets in slices(column, 1 << 22):
        yield a, b, words(buf, offsets, SPACED)


class Frequent:
    """The frequent words, found again by both hashes: their counts and log probabilities."""

    def __init__(self, said: list[str], count: list[int], lm: list[float]):
        w = text_words(said, SPACED)
        order = np.lexsort((w.check, w.hash))
        self.hash, self.check = w.hash[order], w.check[order]
        self.count, self.lm = np.array(count, np.int64)[order], np.array(lm, float)[order]
        self.most = max((b - a for _, a, b in zip(*_runs(self.hash), strict=True)), default=0)  # words of one first hash

    def look(self, w: Words) -> np.ndarray:
        """The place of each word, -1 for other words."""
        out = np.full(len(w.hash), -1)
        at = np.searchsorted(self.hash, w.hash)
        for i in range(self.most):
            x = np.minimum(at + i, len(self.hash) - 1)
            out = np.where((self.hash[x] == w.hash) & (self.check[x] == w.check), x, out)
        return out


def lattice_scores(docs: DataFrame, model_path: str | None = None, rounds: int = 2, word_arcs: bool = False) -> DataFrame:
    """Per document (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    held = F.coalesce(remainder(10) == 0, F.lit(False))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    counted = docs.select("text", (~held).alias("train")).mapInArrow(_count_words, "word string, c long")
    table = materialise(counted.groupBy("word").agg(F.sum("c").alias("c")))
    sums = table.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum((F.col("c") == 1).cast("long"))).first()
    ends = docs.where(~held).count()
    n, v, once = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0), sums[2] or 0
    lam = 1 - once / n if n and word_arcs else 0.0

    pieces, logp, _ = vocabulary(model_path)
    for _ in range(rounds if ends else 0):
        lattice = sc.broadcast(Lattice(pieces, logp))

        def expect(batches: Iterator[pa.RecordBatch], lattice=lattice) -> Iterator[pa.RecordBatch]:
            expected = np.zeros(len(lattice.value.logp))
            for batch in _buffered(batches):
                count = batch.column(1).to_numpy()
                for a, b, w in _each_word(batch.column(0)):
                    lattice.value.score(w.low, w.start, w.end, count[a:b].astype(float), expected)
            some = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(expected[some])], ["piece", "n"])

        expected = np.zeros(len(logp))
        for r in table.where("c > 0").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # pieces at most
            expected[r.piece] = r.n
        expected[-1] = ends
        prior = np.exp(logp) * min(len(logp), 0.1 * expected.sum())
        logp = np.log((expected + prior) / (expected + prior).sum())
    model = sc.broadcast(Lattice(pieces, logp))
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    def mixed(c: np.ndarray, lat: np.ndarray) -> np.ndarray:
        if not lam:
            return lat / np.log(10)
        arc = np.where(c > 0, np.log(np.maximum(lam * c / max(n, 1), 1e-300)), -np.inf)
        return np.logaddexp(arc, np.log(max(1 - lam, 1e-300)) + lat) / np.log(10)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _buffered(batches):
            count = batch.column(1).to_numpy()
            for a, b, w in _each_word(batch.column(0)):
                lat = model.value.score(w.low, w.start, w.end)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count[a:b]), pa.array(mixed(count[a:b], lat))], ["word", "c", "lm"])

    least = max(1, -(-n // _HOT))
    priced = "word string, c long, lm double"
    top = table.where(F.col("c") >= least).mapInArrow(price, priced).toPandas()  # _HOT words at most
    rare = table.where(F.col("c") < least).mapInArrow(price, priced)
    hot = sc.broadcast(Frequent(top["word"].tolist(), top["c"].tolist(), top["lm"].tolist()))
    end_base, end_lm = float(base(ends)), float(mixed(np.array([ends]), np.array([logp[-1]]))[0])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            rows = [np.zeros((0, 4))]
            for a, b, buf, offsets in slices(batch.column(2)):
                w = words(buf, offsets, SPACED)
                at = known.look(w)
                owner, at = w.text()[at >= 0], at[at >= 0]
                some = lambda x, owner=owner, m=b - a: np.bincount(owner, x, m)
                rows.append(np.stack([w.counts() + 1, some(np.ones(len(at))) + (ends > 0), some(base(known.count[at])) + end_base, some(known.lm[at]) + end_lm], 1))
            x = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1].astype(np.int64)), pa.array(x[:, 2]), pa.array(x[:, 3])], ["doc_id", "th", "n_tokens", "known", "base", "lm"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, buf, offsets in slices(batch.column(2)):
                w = words(buf, offsets, SPACED)
                first, tf = distinct_by_text(w)
                cold = hot.value.look(w)[first] < 0
                first, tf = first[cold], tf[cold]
                at = pa.array(a + w.text()[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), gather(w.low, w.start[first], w.end[first]), pa.array(tf.astype(np.int32))], ["doc_id", "th", "word", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = keyed.mapInArrow(near, f"doc_id {kind}, th long, n_tokens long, known long, base double, lm double")
    pairs = keyed.mapInArrow(far, f"doc_id {kind}, th long, word string, tf int")
    c, tf = F.col("c"), F.col("tf")
    one_base = F.log10((c + 0.1) / F.lit(n + 0.1 * (v + 1)))
    cold = pairs.join(rare, "word").groupBy("doc_id", "th").agg(F.sum(F.when(c > 0, tf).otherwise(0)).alias("k2"), F.sum(tf * one_base).alias("b2"), F.sum(tf * F.col("lm")).alias("l2"))
    cold = cold.withColumnsRenamed({"doc_id": "id2", "th": "th2"})
    own = own.withColumn("copies", F.count("*").over(Window.partitionBy("doc_id", "th")))
    out = own.join(cold, F.col("doc_id").eqNullSafe(F.col("id2")) & F.col("th").eqNullSafe(F.col("th2")), "left")
    more = lambda x: F.coalesce(F.col(x), F.lit(0)) / F.col("copies")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + more("k2")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more("b2")).alias("base_score"), (F.col("lm") + more("l2")).alias("score"))
