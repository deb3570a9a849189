"""Fill-in-middle transformation by a parallel automaton scan.

A text's units are ``[A-Za-z]+|[^A-Za-z]``. A four-state automaton over UTF-8 bytes starts them and sees the markers:
other, within letters, after ``<``, after ``<`` and one of P, S, M. Its transition functions form a small monoid, so what
any stretch of bytes does to all four states is one small number. A text is laid out in lanes of ``LANE`` bytes that step
side by side; each lane gives its function and, for every start state, how many units and markers it begins. Composing
functions is associative, so a prefix scan by doubling gives each lane's entry state; sums of the counts that belong to
the entry states then tell which lane holds a cut, and only that lane is walked.

Documents of more than ``giant`` bytes are cut into chunks of ``chunk`` bytes that lie in different tasks. Chunks emit the
same function and counts, a task composes the chunks of a document (2 GB at most, so 65,536 of them), and the chunks that
hold its cuts find them. Only such documents are shuffled.

Prefix, middle and suffix: h1 to h4 are the first four 8-digit groups of the hex sha256 of ``seed:doc_id``; cuts come after
h1 % (n + 1) and h2 % (n + 1) units. A text that is empty or null, that holds a marker, or whose h3 % 100 >= ``percent``
stays plain; else h4 % 100 < ``spm`` makes it spm, the rest psm. A null doc_id is taken as no digits. Repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm._common import materialise
from helixframe.llm._text import slices

LANE = 128
OTHER, LETTERS, OPEN, NAMED = range(4)
#: Byte classes: any other character, letter, one of P S M, `<`, `>`, rest of a character, beyond the text.
PLAIN, LETTER, NAME, LT, GT, REST, PAD = range(7)
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[[ord(c) for c in "PSM"]] = NAME
CLASS[ord("<")], CLASS[ord(">")] = LT, GT
CLASS[128:192] = REST

#: By state and class: the next state, whether a unit starts, whether a marker ends.
NEXT = np.array([[OTHER, LETTERS, NAMED if s == OPEN else LETTERS, OPEN, OTHER, s, s] for s in range(4)], np.uint8)
UNIT = np.array([[1, s in (OTHER, OPEN), s in (OTHER, OPEN), 1, 1, 0, 0] for s in range(4)], np.uint8)
MARK = np.array([[c == GT and s == NAMED for c in range(7)] for s in range(4)], np.uint8)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that stretches of bytes have, the identity first; step by a class; composition; counts of a class."""
    found = [(0, 1, 2, 3)]
    for f in found:
        for c in range(7):
            g = tuple(int(NEXT[s, c]) for s in f)
            if g not in found:
                found.append(g)
    at = {f: i for i, f in enumerate(found)}
    step = np.array([[at[tuple(int(NEXT[s, c]) for s in f)] for c in range(7)] for f in found], np.uint8)
    both = np.array([[at[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8)
    counts = np.array([[[UNIT[s, c] for s in f] + [MARK[s, c] for s in f] for c in range(7)] for f in found], np.uint8)
    return np.array(found, np.uint8), step.ravel(), both, np.ascontiguousarray(counts).view(np.uint64).ravel()


FUNCTIONS, STEP, THEN, COUNTS = _monoid()


class Scan:
    """The lanes of some texts: what each text does from every start state, and where units start."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        lanes = np.maximum(1, -(-size // LANE))
        self.first = np.concatenate([[0], np.cumsum(lanes)])
        self.owner = np.repeat(np.arange(len(size)), lanes)
        flat = np.full(self.first[-1] * LANE, PAD, np.uint8)
        flat[np.arange(len(buf)) + np.repeat(self.first[:-1] * LANE - offsets[:-1], size)] = CLASS[buf]
        self.columns = np.ascontiguousarray(flat.reshape(-1, LANE).T)
        does, packed = np.zeros(self.first[-1], np.uint8), np.zeros(self.first[-1], np.uint64)
        for column in self.columns:
            at = does.astype(np.intp) * 7 + column
            packed += COUNTS[at]
            does = STEP[at]
        self.counts = packed.view(np.uint8).reshape(-1, 8)
        # functions from the text's first lane to each lane, by doubling
        within = np.arange(len(does)) - self.first[self.owner]
        reach = 1
        while reach < lanes.max(initial=1):
            own = np.flatnonzero(within >= reach)
            does[own] = THEN[does[own - reach], does[own]]
            reach *= 2
        self.before = np.where(within > 0, np.concatenate([[0], does[:-1]]), 0)
        self.function = does[self.first[1:] - 1]
        self.lead = (self.columns < REST).sum(0)
        self.chars = np.add.reduceat(self.lead, self.first[:-1])

    def totals(self) -> np.ndarray:
        """By text: units from each of the four start states, then markers."""
        entry = FUNCTIONS[self.before]
        lanes = np.arange(len(entry))[:, None]
        by_lane = np.hstack([self.counts[lanes, entry], self.counts[lanes, entry + 4]]).astype(np.int64)
        return np.add.reduceat(by_lane, self.first[:-1])

    def locate(self, text: np.ndarray, state: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Characters of each of these texts before its unit number target, counted from 0, if the text begins in that state."""
        start = np.zeros(len(self.first) - 1, np.int64)
        start[text] = state
        entry = FUNCTIONS[self.before, start[self.owner]]
        upto = np.cumsum(self.counts[np.arange(len(entry)), entry].astype(np.int64))
        begin = np.concatenate([[0], upto])
        goal = begin[self.first[text]] + target
        lane = np.searchsorted(upto, goal, "right")
        missing, now = goal - begin[lane], entry[lane]
        place = np.full(len(text), LANE)
        for j in range(LANE):
            kind = self.columns[j, lane]
            starts = UNIT[now, kind] == 1
            place[starts & (missing == 0)] = j
            missing = missing - starts
            now = NEXT[now, kind]
        ahead = np.concatenate([[0], np.cumsum(self.lead)])
        inside = ((self.columns[:, lane] < REST) & (np.arange(LANE)[:, None] < place)).sum(0)
        return ahead[lane] - ahead[self.first[text]] + inside


def _cuts(scan: Scan, text: np.ndarray, n: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Characters before each text's cut; a cut after all units is the text's end."""
    out = scan.chars.astype(np.int64)
    some = np.flatnonzero(cut < n)
    out[some] = scan.locate(text[some], np.zeros(len(some), np.int64), cut[some])
    return out


def _whole(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """n, marks, prefix_chars, upto_chars of whole texts."""
    parts = []
    h1, h2 = (np.asarray(h.to_numpy(zero_copy_only=False), np.int64) for h in (h1, h2))
    for a, b, buf, offsets in slices(text):
        scan = Scan(buf, offsets)
        total = scan.totals()
        n, every = total[:, 0], np.arange(b - a)
        x, y = h1[a:b] % (n + 1), h2[a:b] % (n + 1)
        parts.append((n, total[:, 4], _cuts(scan, every, n, np.minimum(x, y)), _cuts(scan, every, n, np.maximum(x, y))))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "marks", "prefix_chars", "upto_chars"])


_FOUND = "struct<n:bigint,marks:bigint,prefix_chars:bigint,upto_chars:bigint>"


def _scanned(chunks: DataFrame) -> DataFrame:
    """Of chunks (key, part, h1, h2, piece): next (function), counts by start state, chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            does, counts, chars = [], [], []
            for _, _, buf, offsets in slices(batch.column(4)):
                scan = Scan(buf, offsets)
                does += FUNCTIONS[scan.function].tolist()
                counts += scan.totals().tolist()
                chars += scan.chars.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(does, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())), pa.array(chars, pa.int64())], ["key", "part", "h1", "h2", "next", "counts", "chars"])

    return chunks.select("key", "part", "h1", "h2", "piece").mapInArrow(run, "key string, part int, h1 long, h2 long, next array<int>, counts array<long>, chars long")


def _composed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The chunks of one document in order: their entry states, and for each cut the chunk, its state and the unit in it."""
    rows = rows.sort_values("part")
    nexts, counts = np.array(rows["next"].tolist()), np.array(rows["counts"].tolist())
    state = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows)):
        state[i] = nexts[i - 1, state[i - 1]]
    every = np.arange(len(rows))
    units, marks = counts[every, state], counts[every, state + 4].sum()
    upto, ahead = np.cumsum(units), np.concatenate([[0], np.cumsum(rows["chars"])])
    n = int(upto[-1])
    out = []
    for which, cut in enumerate(sorted(int(rows[h].iloc[0]) % (n + 1) for h in ("h1", "h2"))):
        at = int(np.searchsorted(upto, cut, "right"))
        if cut == n:
            out.append((key[0], which, None, 0, 0, int(ahead[-1]), n, int(marks)))
        else:
            out.append((key[0], which, int(rows["part"].iloc[at]), int(state[at]), cut - int(upto[at] - units[at]), int(ahead[at]), n, int(marks)))
    return pd.DataFrame(out, columns=["key", "which", "part", "state", "target", "ahead", "n", "marks"]).astype({"part": "Int32"})


def _located(wanted: DataFrame) -> DataFrame:
    """Of (key, which, state, target, ahead, n, marks, piece): chars before the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, target, ahead = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
            found = []
            for a, b, buf, offsets in slices(batch.column(7)):
                found.append(Scan(buf, offsets).locate(np.arange(b - a), state[a:b], target[a:b]) + ahead[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else [], pa.int64()), batch.column(5), batch.column(6)], ["key", "which", "chars", "n", "marks"])

    return wanted.select("key", "which", "state", "target", "ahead", "n", "marks", "piece").mapInArrow(run, "key string, which int, chars long, n long, marks long")


def _giants(rows: DataFrame, giant: int, chunk: int) -> DataFrame | None:
    """key, found of the documents beyond giant bytes; None if there are none."""
    bytes_ = F.col("text").cast("binary")
    pieces = F.expr(f"transform(sequence(0, int((octet_length(text) - 1) div {chunk})), i -> substring(b, i * {chunk} + 1, {chunk}))")
    big = rows.where(F.octet_length("text") > giant).withColumn("b", bytes_)
    chunks = materialise(big.select("key", "h1", "h2", F.posexplode(pieces).alias("part", "piece")).dropDuplicates(["key", "part"]))
    if chunks.isEmpty():
        return None
    states = _scanned(chunks.repartition("key", "part"))
    cuts = materialise(states.groupBy("key").applyInPandas(_composed, "key string, which int, part int, state int, target long, ahead long, n long, marks long"))
    inside = _located(cuts.where("part is not null").join(chunks.select("key", "part", "piece"), ["key", "part"]))
    ends = cuts.where("part is null").select("key", "which", F.col("ahead").alias("chars"), "n", "marks")
    both = inside.union(ends).groupBy("key")
    return both.agg(F.struct(F.first("n").alias("n"), F.first("marks").alias("marks"), F.min("chars").alias("prefix_chars"), F.max("chars").alias("upto_chars")).alias("found"))


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm: int = 20, giant: int = 65_536, chunk: int = 32_768) -> DataFrame:
    """Per document (doc_id, text): n, form, prefix_chars, middle_chars, output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *h)
    # equal keys have equal ids and texts, and so equal cuts
    keyed = rows.withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)))
    scan = F.arrow_udf(_whole, _FOUND)
    small = rows.where(F.octet_length("text") <= giant).withColumn("found", scan("text", "h1", "h2"))
    large = _giants(keyed, giant, chunk)
    if large is not None:
        small = small.unionByName(keyed.where(F.octet_length("text") > giant).join(large, "key").drop("key"))
    form = F.when((F.col("text") == "") | (F.col("found.marks") > 0) | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cut = small.select("doc_id", "text", F.col("found.n").alias("n"), form.alias("form"), F.col("found.prefix_chars").alias("a"), F.col("found.upto_chars").alias("b"))
    part = lambda begin, size: F.substring(F.col("text"), begin, size)
    prefix = part(F.lit(1), F.col("a").cast("int"))
    middle = part((F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    suffix = part((F.col("b") + 1).cast("int"), F.lit(2**31 - 1))
    psm = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle)
    moved = F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", moved).otherwise(F.col("text"))
    known = F.col("form") != "plain"
    return cut.select("doc_id", "n", "form", F.when(known, F.col("a")).alias("prefix_chars"), F.when(known, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: its markers are the only ones in it."""
    after = lambda c, mark: F.substring_index(c, mark, -1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    rest = after(output, "<S>")
    psm = F.concat(after(before(output, "<S>"), "<P>"), after(output, "<M>"), before(rest, "<M>"))
    named = after(output, "<P>")
    spm = F.concat(before(named, "<M>"), after(output, "<M>"), after(before(output, "<P>"), "<S>"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
