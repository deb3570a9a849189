"""Toxicity: a Levenshtein automaton over a lexicon trie finds terms and their misspellings; their contexts are weighed.

The lexicon holds a few fixed terms and what the training labels show: every word that is far more frequent in toxic
documents of the sample (log-odds of ``odds``, in ``least`` of them), without a cap. Its trie is intersected with the
Levenshtein automata of all terms (one edit in characters, or two swapped ones, for terms of ``fuzzy_from`` characters and
more, none below) and made deterministic where texts walk it: one table of states drives all words of a batch at once, and
nearly all words die within a few letters. A match is weighed by its term's log-odds and by its context window: quotation (marks
around the term, or reporting words near) separates mention from abuse, words that address someone speak for abuse.
A logistic regression on these sums gives the score; it is fitted on features from lexicons of the other half of the
training sample, so a term's own document doesn't vouch for it.

Null, empty and wordless texts have no matches and get the score of an empty match list. Very long texts are read whole,
one at a time. Repeated rows get equal scores; a word within one edit of several terms counts as the one of fewest edits,
then the first in order. A score of exactly the threshold is rejected. An empty table gives no rows.
Without labels of both classes the fixed lexicon is used with default weights. Other columns are ignored by ``score``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._common import arrow_batches, materialise
from helixframe.llm._labels import remainder, training_rows
from helixframe.llm._text import ALNUM, Words, distinct_by_text, gather, group, hash_bytes, slices, words

#: Common insults, reporting words and words that address someone, in four languages.
INSULTS = "idiot moron stupid loser trash scum clown pathetic worthless disgusting imbecile dumbass bastard asshole bitch dummkopf arschloch abschaum versager connard salope imbécile ordure abruti estúpido imbécil basura pendejo cabrón gilipollas".split()
REPORTING = "said says wrote writes called quote quoted quoting term word phrase report reported sagte schrieb zitat wort begriff dit écrit citation mot terme dijo escribió cita palabra término".split()
ADDRESSING = "you your youre yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted eres tus vosotros".split()
SWAP = 8  # above all numbers of edits
QUOTES = "\"'`“”„«»‘’‹›"


class Automaton:
    """A lexicon trie intersected with the Levenshtein automata of its terms, made deterministic as far as it is walked.

    A state is a set of (node, edits); with ``SWAP`` and a letter instead of edits, a transposition that still needs that
    letter. One edit is an inserted, a missing, another or two swapped characters.
    """

    def __init__(self, terms: list[str], fuzzy_from: int = 5):
        self.terms, self.fuzzy_from = terms, fuzzy_from
        self.children: list[dict[int, int]] = [{}]
        self.ends, self.fuzzy = [-1], [False]  # the term that ends here; whether a term of the subtree allows an edit
        for i, term in enumerate(terms):
            node, soft = 0, len(term) >= fuzzy_from
            self.fuzzy[0] |= soft
            for b in map(ord, term):
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.fuzzy.append(False)
                node = self.children[node][b]
                self.fuzzy[node] |= soft
            self.ends[node] = i
        self.letters = np.array(sorted({ord(b) for t in terms for b in t}), np.uint32)
        self._begin()

    def _begin(self) -> None:
        start = self._close({(0, 0)})
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.table = np.full((64, len(self.letters) + 1), -1, np.int32)
        self.table[0] = 0
        self.term, self.edits = np.full(64, -1, np.int32), np.zeros(64, np.int8)
        self._number(start)

    def __getstate__(self) -> tuple:
        return self.terms, self.fuzzy_from

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _number(self, state: frozenset) -> int:
        if state in self.ids:
            return self.ids[state]
        i = self.ids[state] = len(self.states)
        self.states.append(state)
        if i == len(self.table):
            more = lambda x, fill: np.concatenate([x, np.full_like(x, fill)])
            self.table, self.term, self.edits = more(self.table, -1), more(self.term, -1), more(self.edits, 0)
        may = lambda t: len(self.terms[t]) >= self.fuzzy_from
        accepted = sorted((e, self.ends[n]) for n, e in state if e < SWAP and self.ends[n] >= 0 and (e == 0 or may(self.ends[n])))
        if accepted:
            self.edits[i], self.term[i] = accepted[0]
        return i

    def _close(self, found: set) -> frozenset:
        """With missing characters; of a node only its fewest edits."""
        for node, e in list(found):
            if e == 0 and self.fuzzy[node]:
                found.update((child, 1) for child in self.children[node].values() if self.fuzzy[child])
        return frozenset(x for x in found if x[1] != 1 or (x[0], 0) not in found)

    def _follow(self, state: frozenset, b: int) -> frozenset:
        found: set[tuple[int, int]] = set()
        for node, e in state:
            if e >= SWAP:
                if b == e - SWAP:
                    found.add((node, 1))
                continue
            hit = self.children[node].get(b)
            if hit is not None and (e == 0 or self.fuzzy[hit]):
                found.add((hit, e))
            if e == 0 and self.fuzzy[node]:
                found.add((node, 1))  # one too many
                for letter, child in self.children[node].items():
                    if letter != b and self.fuzzy[child]:
                        found.add((child, 1))  # another one
                        swapped = self.children[child].get(b)
                        if swapped is not None and self.fuzzy[swapped]:
                            found.add((swapped, SWAP + letter))
        return self._close(found)

    def run(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words that match, their terms and edits, and whether quotation marks stand on both sides."""
        code = np.frombuffer(w.low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        kinds = np.zeros(0x10000, np.uint16)
        kinds[self.letters[self.letters < 0x10000]] = 1 + np.flatnonzero(self.letters < 0x10000)
        kind = kinds[np.minimum(code, 0xFFFF)]
        high = np.flatnonzero(code >= 0xFFFF)
        if len(high):
            at = np.minimum(np.searchsorted(self.letters, code[high]), max(len(self.letters) - 1, 0))
            kind[high] = np.where(self.letters[at] == code[high], at + 1, 0) if len(self.letters) else 0
        places = np.concatenate([[0], np.cumsum((w.low & 0xC0) != 0x80)])  # characters before a byte
        begin, stop = places[w.start], places[w.end]
        # marks above U+007F are bytes of words: they stand around a term, not in it
        marks = np.zeros(0x10000, bool)
        marks[[ord(c) for c in QUOTES]] = True
        marked = marks[np.minimum(code, 0xFFFF)]
        owner = w.text()
        lead = marked[begin] & (stop - begin > 1)
        begin = begin + lead
        tail = marked[stop - 1] & (stop - begin > 1)
        stop = stop - tail
        before = lead | (marked[np.maximum(places[w.start] - 1, 0)] & (w.start > w.offsets[owner]))
        after = tail | (marked[np.minimum(places[w.end], len(code) - 1)] & (w.end < w.offsets[owner + 1])) if len(code) else tail
        length = stop - begin
        final = np.zeros(len(w.start), np.int32)
        alive, state, t = np.arange(len(w.start)), np.ones(len(w.start), np.int32), 0
        while len(alive):
            c = kind[begin[alive] + t]
            to = self.table[state, c]
            if (to < 0).any():
                for key in np.unique(state[to < 0].astype(np.int64) << 16 | c[to < 0]).tolist():
                    s, k = key >> 16, key & 0xFFFF
                    new = self._number(self._follow(self.states[s], int(self.letters[k - 1]) if k else -1))
                    self.table[s, k] = new
                to = self.table[state, c]
            t += 1
            done = length[alive] == t
            final[alive[done]] = to[done]
            go = (to != 0) & ~done
            alive, state = alive[go], to[go]
        at = np.flatnonzero(self.term[final] >= 0)
        return at, self.term[final[at]], self.edits[final[at]], (before & after)[at]


#: Rows of an Arrow batch of texts while the lexicon is learned.
ARROW_ROWS = 1000
NAMES = ("abuse", "quoted", "misspelt", "addressed", "terms", "strongest", "density")


class Lexicon:
    def __init__(self, weights: dict[str, float], fuzzy_from: int = 5):
        terms = sorted(weights)
        self.weight = np.array([weights[t] for t in terms])
        self.automaton = Automaton(terms, fuzzy_from)
        self.reporting = np.array(sorted(hash_bytes(t.encode()) for t in REPORTING), np.uint64)
        self.addressing = np.array(sorted(hash_bytes(t.encode()) for t in ADDRESSING), np.uint64)

    def features(self, w: Words, window: int = 6) -> np.ndarray:
        """Of each text, the sums of NAMES."""
        texts = len(w.first) - 1
        out = np.zeros((texts, len(NAMES)))
        at, term, edits, quoted = self.automaton.run(w)
        if not len(at):
            return out
        owner = np.searchsorted(w.first, at, "right") - 1
        a, b = np.maximum(w.first[owner], at - window), np.minimum(w.first[owner + 1], at + window + 1)

        def near(hashes: np.ndarray) -> np.ndarray:
            """Whether one of some words stands in the window."""
            found = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
            upto = np.concatenate([[0], np.cumsum(hashes[found] == w.hash)])
            return upto[b] > upto[a]

        weight = self.weight[term]
        quoted = quoted | near(self.reporting)
        into = np.where(quoted, 1, np.where(edits > 0, 2, 0))
        out[:, :3] = np.bincount(owner * 3 + into, weight, texts * 3).reshape(texts, 3)
        out[:, 3] = np.bincount(owner, weight * near(self.addressing), texts)
        out[:, 4] = np.bincount(np.unique(owner * len(self.weight) + term) // len(self.weight), minlength=texts)
        np.maximum.at(out[:, 5], owner, weight * np.where(quoted | (edits > 0), 0.5, 1))
        out[:, 6] = (out[:, 0] + out[:, 2]) / np.maximum(w.counts(), 1) ** 0.5
        out[:, :5] = np.log1p(out[:, :5])
        return out


def _odds(p: float, n: float, pos: int, neg: int) -> float:
    return math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))


def _learned(counts: list, pos: int, neg: int, fold: int | None, least: int, odds: float) -> dict[str, float]:
    """Terms by smoothed log-odds, weighed down where chance among many words may explain them.

    ``proof`` is -log10 of the chance that so many of a word's documents are toxic; six and more count in full.
    fold: without what that half of the sample shows.
    """
    found, rate = {}, pos / max(pos + neg, 1)
    for r in counts:
        p, n = (r.p0 + r.p1, r.n0 + r.n1) if fold is None else (r.p1, r.n1) if fold == 0 else (r.p0, r.n0)
        if p >= least and n <= p and (lo := _odds(p, n, pos, neg)) >= odds:
            ways = math.lgamma(p + n + 1) - math.lgamma(p + 1) - math.lgamma(n + 1)
            proof = -(ways + p * math.log(max(rate, 1e-9)) + n * math.log(max(1 - rate, 1e-9))) / math.log(10)
            found[r.w] = min(lo, 8.0) * min(max((proof - 1) / 5, 0.05), 1.0)
    return {t: 3.0 for t in INSULTS} | found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the constant last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    r = np.full(x.shape[1], ridge)
    r[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(r)
        step = np.linalg.solve(h, x.T @ (y - p) - r * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, least: int = 3, odds: float = 2.0, fuzzy_from: int = 5) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and regression weights, from at most train_rows labelled rows outside the held-out quarter."""
    spark = docs.sparkSession
    sample = materialise(training_rows(docs, labels, "toxic", remainder(4) != 2, train_rows).select("text", "label", F.expr("pmod(th, 2)").alias("fold")))
    rows = sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()
    n = {(int(r.fold), r.label): r.n for r in rows}
    total = lambda y, f=None: sum(v for (a, b), v in n.items() if b == y and a != f)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, _, buf, offsets in slices(batch.column(0)):
                w = words(buf, offsets, ALNUM)
                first, _ = distinct_by_text(w)  # a word of a text once
                place, inv, _ = group(w.hash[first], w.hash[first], w.check[first])
                doc = a + w.text()[first]
                sums = [np.bincount(inv, (label[doc] == y) & (fold[doc] == f), len(place)).astype(np.int64) for y in (1, 0) for f in (0, 1)]
                said = gather(w.low, w.start[first[place]], w.end[first[place]])
                yield pa.RecordBatch.from_arrays([said, *(pa.array(s) for s in sums)], ["w", "p0", "p1", "n0", "n1"])

    counts = []
    if total(1) and total(0):
        each = sample.mapInArrow(count, "w string, p0 long, p1 long, n0 long, n1 long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("p0", "p1", "n0", "n1")])
        one = lambda p, q, f: (F.col(p) >= max(2, least - 1)) & (F.col(q) <= F.col(p)) & (F.log((F.col(p) + 0.5) / (total(1, f) + 1)) - F.log((F.col(q) + 0.5) / (total(0, f) + 1)) >= odds - 1e-9)
        each = each.withColumn("p", F.col("p0") + F.col("p1")).withColumn("q", F.col("n0") + F.col("n1"))
        with arrow_batches(spark, ARROW_ROWS):  # terms of at least two toxic documents of the sample: bounded by it
            counts = each.where(one("p", "q", None) | one("p1", "n1", 0) | one("p0", "n0", 1)).orderBy("w").collect()
    lexicon = Lexicon(_learned(counts, total(1), total(0), None, least, odds), fuzzy_from)
    if not counts:
        return lexicon, np.array([1.0, 0.2, 0.4, 0.3, 0.5, 0.0, 0.0, -3.5])
    halves = spark.sparkContext.broadcast([Lexicon(_learned(counts, total(1, f), total(0, f), f, max(2, least - 1), odds), fuzzy_from) for f in (0, 1)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = batch.column(2).to_numpy(), np.zeros((batch.num_rows, len(NAMES)))
            for a, b, buf, offsets in slices(batch.column(0)):
                w = words(buf, offsets, ALNUM)
                f = fold[a:b]
                x[a:b] = np.where(f[:, None] == 0, halves.value[0].features(w), halves.value[1].features(w))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    with arrow_batches(spark, ARROW_ROWS):
        seen = sample.mapInArrow(measure, "label int, x array<double>").collect()  # train_rows at most
    return lexicon, logistic(np.array([r.x for r in seen]), np.array([r.label for r in seen], float))


def _probability(model: tuple[Lexicon, np.ndarray], texts: pa.Array) -> np.ndarray:
    lexicon, weights = model
    parts = [lexicon.features(words(buf, offsets, ALNUM)) @ weights[:-1] + weights[-1] for _, _, buf, offsets in slices(texts)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -30, 30))) if parts else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per document (doc_id, text): doc_id, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probability(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """docs, all columns, without those that score threshold or more."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probability(model.value, batch.column(at)) < threshold))

    return docs.mapInArrow(keep, docs.schema)
