"""License scans by ordered signature rules.

A rule is a regular expression over the words of a text (lower-cased, single spaces), a label, a priority and a confidence.
Its keywords are derived from the pattern, all of whose forms are listed: each form holds one of them as a whole word.
Keywords are looked up for all words of a batch at once; rules run only on the stretches around the keywords that gate
them. Those hold every match whole, as none has more words than its pattern's ``reach``, so the prefilter changes nothing.
Detections are taken by priority, then length, then place, then rule (so ties are settled); one whose words all lie within
a detection taken before is suppressed. The base phrases are found for all texts and always stay.

Null, empty and wordless texts have no words and no labels: n_words 0, first_word and last_word null, labels empty, score
0. Long texts are read whole: only the words around keywords are put together. Repeated rows give equal results; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm._license_rules import NAMES, NOTICES, SHORT, version_rules
from helixframe.llm._text import ALNUM, Words, hash_bytes, slices, words

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Words that make poor keywords: they stand in most texts.
_POOR = frozenset("a an and any are as at be but by can for free from general if in into is it its may must name no not of on only open or other public shall should software source that the this to under use used was with without you your 0 1 2 3 4 5 01".split())
_ANY, _LICENSED = "\0", "\1"  # in listed forms of a pattern: some character; a word for a license


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    confidence: float
    #: Every match holds one of these words; none has more words than ``reach``.
    keywords: tuple[str, ...]
    reach: int


def _forms(nodes: Iterable) -> list[str]:
    """What a parsed pattern matches, with repeats as short as they may be and ``_ANY`` for open characters."""
    out = [""]
    for op, arg in nodes:
        kind = str(op)
        if kind == "LITERAL":
            new = [chr(arg)]
        elif kind == "SUBPATTERN":
            new = _forms(arg[-1])
        elif kind == "BRANCH":
            new = [f for x in arg[1] for f in _forms(x)]
        elif kind == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            new = [chr(c) for _, c in arg]
        elif kind in ("IN", "NOT_LITERAL", "ANY"):
            new = [_ANY]
        elif kind == "MAX_REPEAT":
            least, most, x = arg
            one = _forms(x)
            new = ["", *one] if (least, most) == (0, 1) else ["".join(f) for f in itertools.product(one, repeat=least)]
        else:
            raise ValueError(f"{kind} in a rule")
        out = list(dict.fromkeys(a + b for a in out for b in new))
    return out


def _spaces(nodes: Iterable) -> int:
    """The most spaces that a parsed pattern matches."""
    n = 0
    for op, arg in nodes:
        kind = str(op)
        if kind == "LITERAL":
            n += arg == 32
        elif kind == "SUBPATTERN":
            n += _spaces(arg[-1])
        elif kind == "BRANCH":
            n += max(map(_spaces, arg[1]))
        elif kind == "MAX_REPEAT" and _spaces(arg[2]):
            n += arg[1] * _spaces(arg[2])
    return n


def _cost(word: str) -> float:
    return 12 if word in _POOR else 3 if word == _LICENSED else 6 / len(word) + 1


def keywords(pattern: str) -> tuple[str, ...]:
    """Words one of which every match of the pattern (with ``<L>``) holds as a whole word: the cheapest found greedily."""
    said = parser.parse(pattern.replace("<L>", _LICENSED).replace("<V>", SHORT["<V>"]))
    forms = {frozenset(w for w in f.split(" ") if w == _LICENSED or (w and _ANY not in w and _LICENSED not in w)) for f in _forms(said)}
    if not all(forms):
        raise ValueError(f"no keyword in {pattern}")
    out = []
    while forms:
        words = sorted({w for f in forms for w in f})
        best = max(words, key=lambda w: (sum(w in f for f in forms) / _cost(w), w))
        out += SHORT["<L>"][3:-1].split("|") if best == _LICENSED else [best]
        forms = {f for f in forms if best not in f}
    return tuple(out)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    out = []
    for label, said, priority, sure in (*NOTICES, *NAMES, *version_rules()):
        pattern = said.replace("<L>", SHORT["<L>"]).replace("<V>", SHORT["<V>"])
        out.append(Rule(label, pattern, priority, sure, keywords(said), _spaces(parser.parse(pattern)) + 1))
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern)))


def uncontained(found: Iterable[tuple[int, int, int]], rank: Callable) -> list[tuple[int, int, int]]:
    """Of (first, last, rule) those that lie in none taken before, by rank: kept ones that contain no other form a staircase."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for s, e, r in sorted(found, key=rank):
        i = bisect.bisect_right(starts, s)
        if i and ends[i - 1] >= e:
            continue
        kept.append((s, e, r))
        i = bisect.bisect_left(starts, s)
        j = i
        while j < len(starts) and ends[j] <= e:
            j += 1
        starts[i:j], ends[i:j] = [s], [e]
    return sorted(kept)


class Scanner:
    def __init__(self, own: tuple[Rule, ...]) -> None:
        self.rules = own
        self.regex: dict[int, re.Pattern] = {}  # compiled when a keyword first asks for them
        gated: dict[int, list[int]] = defaultdict(list)
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                gated[hash_bytes(k.encode())].append(i)
        self.gated = dict(gated)
        self.reach = {k: max(self.rules[i].reach for i in of) for k, of in gated.items()}
        self.keys = np.array(sorted(gated), np.uint64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.keys >> np.uint64(48)] = True
        self.base = [([x.encode() for x in phrase.split()], label) for phrase, label in BASE]
        self.rank = lambda f: (-self.rules[f[2]].priority, f[0] - f[1], f)

    def base_places(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and phrase of each base place."""
        left = np.repeat(w.first[1:], w.counts()) - np.arange(len(w.hash))
        found = []
        for p, (phrase, _) in enumerate(self.base):
            n = len(w.hash) - len(phrase) + 1
            if n > 0:
                ok = left[:n] >= len(phrase)
                for t, word in enumerate(phrase):
                    ok &= w.hash[t : t + n] == np.uint64(hash_bytes(word))
                found += [(i, p) for i in np.flatnonzero(ok).tolist() if all(w.word(i + t) == word for t, word in enumerate(phrase))]
        at = np.array([f[0] for f in found], np.int64)
        text = np.searchsorted(w.first, at, "right") - 1
        return text, at - w.first[text], np.array([f[1] for f in found], np.int64)

    def matches(self, said: list[str], which: Iterable[int], at: int = 0) -> Iterator[tuple[int, int, int]]:
        """First word, last word (exclusive) and rule of each match of some rules in some words; at: number of the first."""
        line, starts = " ".join(said), np.cumsum([0, *(len(s) + 1 for s in said)])
        for r in which:
            if r not in self.regex:
                self.regex[r] = re.compile(rf"(?<![^ ])(?:{self.rules[r].pattern})(?![^ ])")
            ends = [x for m in self.regex[r].finditer(line) for x in m.span()]
            if ends:
                word = np.searchsorted(starts, ends, "right") - 1 + at
                yield from ((s, e + 1, r) for s, e in zip(word[::2].tolist(), word[1::2].tolist(), strict=True))

    def detections(self, w: Words) -> dict[int, list[tuple[int, int, int]]]:
        """Per text the detections kept: first word, last word (exclusive), rule."""
        at = np.flatnonzero(self.seen[w.hash >> np.uint64(48)])
        at = at[self.keys[np.minimum(np.searchsorted(self.keys, w.hash[at]), len(self.keys) - 1)] == w.hash[at]]
        text = np.searchsorted(w.first, at, "right") - 1
        out = {}
        for i, places in itertools.groupby(zip(text.tolist(), at.tolist(), strict=True), key=lambda x: x[0]):
            a, b = int(w.first[i]), int(w.first[i + 1])
            runs: list[list] = []
            for _, p in places:
                key = int(w.hash[p])
                lo, hi, keys = max(a, p - self.reach[key]), min(b, p + self.reach[key] + 1), {key}
                while runs and lo <= runs[-1][1]:  # a wide stretch may reach back over several
                    x, y, z = runs.pop()
                    lo, hi = min(lo, x), max(hi, y)
                    z |= keys
                    keys = z
                runs.append([lo, hi, keys])
            found = set()
            for lo, hi, keys in runs:
                said = [w.word(t).decode("utf-8", "replace") for t in range(lo, hi)]
                found.update(self.matches(said, sorted({r for k in keys for r in self.gated[k]}), lo - a))
            if found:
                out[i] = uncontained(found, self.rank)
        return out


@functools.cache
def scanner(own: tuple[Rule, ...] | None = None) -> Scanner:
    return Scanner(own or rules())


def scan(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(rules())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(shared.value)
        for batch in batches:
            rows = []
            for _, _, buf, offsets in slices(batch.column(1)):
                w = words(buf, offsets, ALNUM)
                base = defaultdict(list)
                for i, p, k in zip(*(x.tolist() for x in s.base_places(w)), strict=True):
                    base[i].append((p, s.base[k][1]))
                more = s.detections(w)
                for i, n in enumerate(w.counts().tolist()):
                    b, d = base.get(i, ()), more.get(i, ())
                    places, own = [p for p, _ in b], {k for _, k in b}
                    labels = own | {s.rules[r].label for _, _, r in d}
                    doubt = float(np.prod([1 - s.rules[r].confidence for _, _, r in d])) * 0.4 ** len(own)
                    spans = ",".join(f"{s.rules[r].label}:{x}:{y}" for x, y, r in d)
                    rows.append((n, len(b), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1 - doubt if labels else 0.0, spans))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
