"""Substring dedup: words covered by a window of ``window`` words that also starts anywhere else are removed.

A window is known by 128 bits of its words' hashes. Few windows repeat, so they are not all grouped exactly:

1. Documents are stored in units of ``UNIT_ROWS`` rows (one of more than ``giant`` bytes is its own unit), bucketed by unit,
   so that no later step shuffles a text.
2. Each unit sketches its windows. The hash range is cut into stripes of about ``stripe_windows`` windows; a stripe's
   count-min sketch has two rows of counters, and a unit's part of it is sparse: the 32-bit fingerprints that name its cells,
   each once, or twice if the unit holds it more often. A task merges the parts of a stripe into counters that stop at 2 and
   returns to each unit the fingerprints whose smaller counter is 2. Counters never fall short, so no repeated window is lost.
3. Only windows estimated repeated are grouped by all 128 bits: first within their unit, so that a window of very many
   documents is sent once a unit, then over all units of their stripe. Units get back the places of repeated windows.
4. Units mark the words that those windows cover and join what is left.

Windows are judged on the input, not on what is left; they never span two documents. A null or wordless text has no words and
keeps the empty text, as does one whose words all go; texts of fewer words than a window stay, their words joined by one
space. Repeated rows repeat each other's windows. A null doc_id is a row like any other; other columns are ignored; an empty
table gives no rows. Units and stripes bound memory: with very much input raise both, so that a unit sends each stripe
more than a few fingerprints.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._common import materialise, shuffle_partitions, tables_folder
from helixframe.llm._text import SPACED, group, left, shingles, slices, words

UNIT_ROWS_LOG2 = 11
UNIT_ROWS = 1 << UNIT_ROWS_LOG2
#: Counters a window has in each row of the sketch.
ROOM = 8
#: Odd multipliers that spread a fingerprint over each row.
ODD = (np.uint64(0x9E3779B1), np.uint64(0x85EBCA77))
_LOW32 = np.uint64(0xFFFFFFFF)


def packed(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as byte planes of their differences, which shuffles compress."""
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.uint64)).astype(np.uint64)


def stored_units(docs: DataFrame, giant: int) -> DataFrame:
    """unit, rid, doc_id, size, text: the documents in the shared folder, bucketed by unit."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    unit = F.when(F.col("size") > giant, -1 - F.col("rid")).otherwise(F.shiftright("rid", UNIT_ROWS_LOG2))
    name = f"units_{uuid.uuid4().hex}"
    out = rows.select(unit.alias("unit"), "rid", "doc_id", "size", "text").write.option("compression", "zstd").option("path", f"{tables_folder(spark)}/{name}")
    out.bucketBy(max(1, min(shuffle_partitions(spark), 100_000)), "unit").sortBy("unit", "rid").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: its files lie in a folder of our own
    return table


class _Unit:
    """A unit's texts in the order of their rows."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("rid").to_numpy(), kind="stable")
        self.rows = rows.take(pa.array(order)).combine_chunks()
        self.texts = self.rows.column("text").combine_chunks()

    def words(self) -> Iterator[tuple]:
        """Runs of texts: first, last (exclusive), their words, number of words before them."""
        before = 0
        for a, b, buf, offsets in slices(self.texts):
            w = words(buf, offsets, SPACED, lower=False)
            yield a, b, w, before
            before += len(w.hash)

    def windows(self, k: int, wanted: np.ndarray | None = None, stripes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and place of each window; wanted: only windows whose names (see ``names``) are among these."""
        out = []
        for _, _, w, before in self.words():
            at = np.flatnonzero(left(w) >= k)
            h = shingles(w, k)[at]
            if wanted is None:
                out.append((h, h, at + before))
                continue
            name = names(h, stripes)
            where = np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)
            hot = wanted[where] == name
            if hot.any():
                at = at[hot]
                out.append((h[hot], shingles(w, k, 1)[at], at + before))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def names(h: np.ndarray, stripes: int) -> np.ndarray:
    """Stripe and fingerprint of each window: upper and lower 32 bits."""
    return ((((h >> np.uint64(32)) * np.uint64(stripes)) >> np.uint64(32)) << np.uint64(32)) | (h & _LOW32)


def _by_stripe(name: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Stripe and range of each run of a sorted array of names."""
    stripe = (name >> np.uint64(32)).astype(np.int64)
    cuts = [*np.flatnonzero(np.diff(stripe, prepend=-1)).tolist(), len(stripe)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(stripe[a]), a, b


class Sketch:
    """The count-min sketch of a stripe; counters stop at 2."""

    def __init__(self, width: int):
        self.shift = np.uint64(32 - max(1, int(np.ceil(np.log2(width)))))
        self.rows = [np.zeros(1 << int(32 - self.shift), np.uint8) for _ in ODD]

    def cells(self, row: int, prints: np.ndarray) -> np.ndarray:
        return (((prints * ODD[row]) & _LOW32) >> self.shift).astype(np.int64)

    def merge(self, prints: np.ndarray) -> None:
        """Adds a unit's part."""
        for row, counter in enumerate(self.rows):
            cell, n = np.unique(self.cells(row, prints), return_counts=True)
            counter[cell] = np.minimum(2, counter[cell] + n)

    def estimate(self, prints: np.ndarray) -> np.ndarray:
        return np.minimum(*(counter[self.cells(row, prints)] for row, counter in enumerate(self.rows)))


def estimated_repeats(units: DataFrame, window: int, stripes: int, width: int) -> DataFrame:
    """unit, stripe, prints: fingerprints of each unit whose windows may repeat."""

    def sketch(rows: pa.Table) -> pa.Table:
        name, n = np.unique(names(_Unit(rows).windows(window)[0], stripes), return_counts=True)
        twice = np.repeat(name, np.minimum(n, 2))
        parts = [(s, packed(twice[a:b] & _LOW32)) for s, a, b in _by_stripe(twice)]
        unit = rows.column("unit")[0].as_py()
        return pa.table({"stripe": pa.array([p[0] for p in parts], pa.int32()), "unit": pa.array([unit] * len(parts), pa.int64()), "prints": pa.array([p[1] for p in parts], pa.binary())})

    def merge(rows: pa.Table) -> pa.Table:
        merged, parts = Sketch(width), rows.column("prints")
        for p in parts:
            merged.merge(unpacked(p.as_py()))
        unit, hot = [], []
        for u, p in zip(rows.column("unit").to_pylist(), parts, strict=True):
            prints = np.unique(unpacked(p.as_py()))
            prints = prints[merged.estimate(prints) >= 2]
            if len(prints):
                unit.append(u)
                hot.append(packed(prints))
        return pa.table({"unit": pa.array(unit, pa.int64()), "stripe": pa.array([rows.column("stripe")[0].as_py()] * len(unit), pa.int32()), "prints": pa.array(hot, pa.binary())})

    partial = units.select("unit", "rid", "text").groupBy("unit").applyInArrow(sketch, "stripe int, unit long, prints binary")
    return partial.groupBy("stripe").applyInArrow(merge, "unit long, stripe int, prints binary")


def repeated_places(units: DataFrame, hot: DataFrame, window: int, stripes: int) -> DataFrame:
    """unit, places: words of each unit (in the order of its rows) where a window starts that starts elsewhere too."""

    def gather(rows: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {"stripe": [], "unit": [], "first": [], "second": [], "places": [], "weights": []}
        if rows.num_rows and found.num_rows:
            unit = rows.column("unit")[0].as_py()
            wanted = np.sort(np.concatenate([unpacked(p.as_py()) | np.uint64(s << 32) for s, p in zip(found.column("stripe").to_pylist(), found.column("prints"), strict=True)]))
            h1, h2, place = _Unit(rows).windows(window, wanted, stripes)
            if len(place):
                first, which, n = group(h1, h1, h2)
                own = place[n[which] > 1]  # repeated in the unit: told already
                order = np.argsort(place[first])
                first, n = first[order], n[order]
                name = names(h1[first], stripes)
                by = np.argsort(name >> np.uint64(32), kind="stable")
                for s, a, b in _by_stripe(name[by]):
                    at = by[a:b]
                    for column, value in zip(out, (s, unit, h1[first[at]].tobytes(), h2[first[at]].tobytes(), packed(place[first[at]]), np.minimum(n[at], 2).astype(np.uint8).tobytes()), strict=True):
                        out[column].append(value)
                if len(own):
                    for column, value in zip(out, (unit % stripes, unit, None, None, packed(np.sort(own)), None), strict=True):
                        out[column].append(value)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    def exact(rows: pa.Table) -> pa.Table:
        told = rows.filter(rows.column("first").is_null())
        rows = rows.filter(rows.column("first").is_valid())
        unit, places = told.column("unit").to_pylist(), told.column("places").to_pylist()
        if rows.num_rows:
            joined = {c: b"".join(rows.column(c).to_pylist()) for c in ("first", "second", "weights")}
            h1, h2, n = np.frombuffer(joined["first"], np.uint64), np.frombuffer(joined["second"], np.uint64), np.frombuffer(joined["weights"], np.uint8)
            _, which, _ = group(h1, h1, h2)
            again = (np.bincount(which, n)[which] > 1) & (n == 1)
            at = 0
            for u, p in zip(rows.column("unit").to_pylist(), rows.column("places"), strict=True):
                place = unpacked(p.as_py())
                here = place[again[at : at + len(place)]]
                at += len(place)
                if len(here):
                    unit.append(u)
                    places.append(packed(here))
        return pa.table({"unit": pa.array(unit, pa.int64()), "places": pa.array(places, pa.binary())})

    candidates = units.select("unit", "rid", "text").groupBy("unit").cogroup(hot.groupBy("unit")).applyInArrow(gather, "stripe int, unit long, first binary, second binary, places binary, weights binary")
    return candidates.groupBy("stripe").applyInArrow(exact, "unit long, places binary")


def _joined(w, keep: np.ndarray) -> pa.Array:
    """Each text's words that are kept, joined by one space."""
    at = np.flatnonzero(keep)
    size = w.end[at] - w.start[at] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    low = np.append(w.low, np.uint8(32))
    raw = low[np.repeat(w.start[at] - to[:-1], size) + np.arange(to[-1])]
    raw[to[1:] - 1] = 32
    upto = np.concatenate([[0], np.cumsum(keep)])[w.first]  # kept words before each text
    some = np.diff(upto) > 0
    stays = np.ones(len(raw), bool)
    stays[to[upto[1:][some]] - 1] = False
    sizes = to[upto[1:]] - to[upto[:-1]] - some
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[stays]))])


def remove_repeats(docs: DataFrame, window: int = 35, stripe_windows: int = 1 << 22, giant: int = 1 << 20) -> DataFrame:
    """Per document (doc_id, text): n_words, n_removed, kept (the words left, joined by one space)."""
    units = stored_units(docs, giant)
    size = units.agg(F.sum("size")).first()[0] or 0
    stripes = max(1, -(-size // (6 * stripe_windows)))  # about 6 bytes a word
    hot = materialise(estimated_repeats(units, window, stripes, ROOM * stripe_windows))
    places = materialise(repeated_places(units, hot, window, stripes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        unit = _Unit(rows)
        start = np.sort(np.concatenate([unpacked(p.as_py()).astype(np.int64) for p in found.column("places")])) if found.num_rows else np.zeros(0, np.int64)
        n, removed, kept = [], [], []
        for _, _, w, before in unit.words():
            own = start[np.searchsorted(start, before) : np.searchsorted(start, before + len(w.hash))] - before
            edge = np.bincount(own, minlength=len(w.hash) + 1) - np.bincount(own + window, minlength=len(w.hash) + 1)
            gone = np.cumsum(edge)[: len(w.hash)] > 0
            n.append(w.counts())
            upto = np.concatenate([[0], np.cumsum(gone)])[w.first]
            removed.append(np.diff(upto))
            kept.append(_joined(w, ~gone))
        ints = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (n, removed)]
        text = pa.chunked_array(kept, pa.large_string()).cast(pa.string()) if kept else pa.array([], pa.string())
        return pa.table([unit.rows.column("doc_id"), *ints, text], ["doc_id", "n_words", "n_removed", "kept"])

    rows = units.select("unit", "rid", "doc_id", "text").groupBy("unit").cogroup(places.groupBy("unit"))
    return rows.applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
