"""Whole-batch text kernels: words and shingles of UTF-8 buffers as numpy arrays.

The word classes are byte classes, so they are exact on UTF-8: every byte of a character above U+007F is at least
0x80. A word's two hashes are of 64 bits each: one finds candidates, both together (or the word's bytes) decide equality,
and shingles carry two likewise. Words of more than 64 bytes are digested by BLAKE2.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing, and `[^\x20\x09-\x0D]`.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
SPACED = np.ones(256, bool)
SPACED[32] = SPACED[9:14] = False

#: First 8-byte chunks of a word are mixed one after the other; longer words are digested whole.
_LONG = 64
_KEEP = np.array([2**64 - 1 if n == 8 else 2 ** (8 * n) - 1 for n in range(9)], np.uint64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_STEP = _rng.integers(1, 2**64, (2, 64), dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _digest(low: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """One of two independent 64-bit hashes of each low[start:end]; up to 8 bytes of one length never collide."""
    size = end - start
    chunk = np.ndarray((len(low) + 1,), "<u8", np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix((chunk[start] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ _STEP[which, 63])
    rest, t = np.flatnonzero(size > 8), 8
    while len(rest) and t < _LONG:
        x = chunk[start[rest] + t] & _KEEP[np.minimum(size[rest] - t, 8)]
        h[rest] = mix(h[rest] * _STEP[which, 62] + x)
        t += 8
        rest = rest[size[rest] > t]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return h


@dataclass
class Words:
    """Words of some texts: hash, first and last byte (exclusive) in ``low``; words of text i: first[i] to first[i+1]."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # where each text begins in low, and the last one ends

    @functools.cached_property
    def check(self) -> np.ndarray:
        """A second hash of each word: with ``hash``, 128 bits that stand for the word."""
        return _digest(self.low, self.start, self.end, 1)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """The words of the texts that lie in buf between offsets, ASCII lower-cased unless told otherwise."""
    w = word_bounds(buf, offsets, kind, lower)
    w.hash = _digest(w.low, w.start, w.end, 0)
    return w


def word_bounds(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """words() without their hashes."""
    n = len(buf)
    low = LOWER[buf] if lower else buf
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[low]
    here, cut = inside[1:-1], offsets[1:-1]
    opens, closes = here & ~inside[:-2], here & ~inside[2:]
    cut = cut[(cut > 0) & (cut < n)]
    opens[cut] = here[cut]
    closes[cut - 1] = here[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(low, start, end, np.zeros(0, np.uint64), np.searchsorted(start, offsets), offsets)


def group(key: np.ndarray, *exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, number of each row's group and size of the groups of rows equal in ``exact``; key is a hash of those."""
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if all((x[first][inverse] == x).all() for x in exact):
        return first, inverse, n
    order = np.lexsort(exact)
    new = np.ones(len(key), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in exact], axis=0)
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, np.bincount(inverse)


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of all texts, as ``group`` gives them."""
    return group(w.hash, w.hash, w.check)


def distinct_by_text(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word of each text, and how often the text holds it."""
    owner = w.text()
    first, _, n = group(mix(w.hash + owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), owner, w.hash, w.check)
    return first, n


def hash_bytes(word: bytes) -> int:
    """The hash that words() gives to one word."""
    w = words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), np.ones(256, bool))
    return int(w.hash[0])


def shingles(w: Words, k: int, which: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; wrong where fewer than k words of its text are left."""
    own = w.check if which else w.hash
    n = len(own) - k + 1
    out = np.zeros(len(own), np.uint64)
    if n > 0:
        total = own[:n] * _STEP[which, 0]
        for t in range(1, k):
            total += own[t : t + n] * _STEP[which, t]
        out[:n] = mix(total + np.uint64(k))
    return out


def left(w: Words) -> np.ndarray:
    """Words from each word to the end of its text, itself included."""
    return np.repeat(w.first[1:], w.counts()) - np.arange(len(w.hash))


class Shingles(NamedTuple):
    """A set of shingles, each known by 128 bits: sorted 64-bit hashes and, beside them, second ones."""

    hash: np.ndarray
    check: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def shared(self, other: Shingles) -> int:
        """How many shingles both sets hold."""
        at = np.minimum(np.searchsorted(self.hash, other.hash), len(self.hash) - 1)
        return int(((self.hash[at] == other.hash) & (self.check[at] == other.check)).sum())

    def identity(self) -> bytes:
        return hashlib.blake2b(self.hash.tobytes() + self.check.tobytes(), digest_size=16).digest()


def _set(hashes: np.ndarray, check: np.ndarray) -> Shingles:
    order = np.argsort(hashes)
    a, b = hashes[order], check[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # equal by one hash only
        order = np.lexsort((check, hashes))
        a, b = hashes[order], check[order]
        same = a[1:] == a[:-1]
    keep = np.ones(len(a), bool)
    keep[1:] = ~(same & (b[1:] == b[:-1]))
    return Shingles(a[keep], b[keep])


def shingle_sets(w: Words, k: int) -> list[Shingles]:
    """Per text its distinct k-word shingles; fewer words: the whole sequence as one; no words: empty."""
    count, first = w.counts(), w.first
    both = lambda m: (shingles(w, m), shingles(w, m, 1))
    full, short = both(k), {m: both(m) for m in np.unique(count[(count > 0) & (count < k)]).tolist()}
    out = []
    for i, m in enumerate(count.tolist()):
        a = first[i]
        x, b = (full, a + m - k + 1) if m >= k else (short.get(m, full), a + (m > 0))
        out.append(_set(x[0][a:b], x[1][a:b]))
    return out


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about limit bytes (one text at least): first, last (exclusive), bytes, offsets. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def text_words(texts: list[str | None], kind: np.ndarray) -> Words:
    """words() of Python strings."""
    raw = [(t or "").encode() for t in texts]
    return words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), kind)


def gather(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings low[start:end]."""
    size = end - start
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[at]))]).cast(pa.string())
