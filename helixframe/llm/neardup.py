"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct ``k``-word shingles. Register i of its sketch is
``floor(1 - log_b(min E_i))`` clipped to 0..q+1, where E_i are exponential variates of rate a that a seeded hash gives to
the elements: exponentially spaced, truncated minima, which merge by maximum. Equal registers become likelier with the
Jaccard similarity, so documents meet in bands of ``rows`` registers. For pairs that meet, the similarity is estimated
jointly by maximum likelihood from how many registers are larger, smaller and equal, given both set sizes; what stays
plausible (5 standard errors below the threshold) is verified on the full sets.

A shingle is known by 128 bits (two hashes of its words), and so is a set. Equal sets form one class before any pair is
made. In a bucket, classes are first held against its smallest class only;
the links found give components, and then only pairs of a bucket that still lie in different components are tried, in
blocks, each pair in its first common band. So no bucket emits all its pairs, and yet every pair of a bucket is either
verified or already known to be connected. With 32 bands of 4 registers a pair of similarity 0.75 is missed with probability 5e-6.

A text with 1 to k-1 words is one shingle; a null, empty or wordless text has an empty set and is linked with nothing:
its own doc_id is its component. So is a row without a doc_id (component null, kept). Texts of any length keep their whole sets, and a block holds one text at least. Repeated rows give
repeated results; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.llm._common import block_pairs, by_group, components, materialise
from helixframe.llm._text import SPACED, shingle_sets, slices, words

BASE, RATE, TOP = 1.001, 20.0, 65535
#: Rows of an Arrow batch that holds texts and registers: its buffers lie outside the heap.
ARROW_ROWS = 1000


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(1, 2**64, (m, 1), dtype=np.uint64), rng.integers(1, 2**64, (m, 1), dtype=np.uint64) | np.uint64(1)


def registers(elements: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes."""
    flip, times = seeds
    low = np.full(len(flip), 2**64 - 1, np.uint64)
    for a in range(0, len(elements), 1024):
        np.minimum(low, ((elements[None, a : a + 1024] ^ flip) * times).min(axis=1), out=low)
    first = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(first) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows of a and b), given the set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi, g = np.zeros(len(u)), most, (np.sqrt(5) - 1) / 2
    for _ in range(30):  # the likelihood is unimodal: golden section
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(x) >= likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), n, s1, s2 (128 bits that stand for the set), bands: the registers, 4 to a long."""
    if rows != 4:
        raise ValueError("a band is one long: 4 registers")
    seeds = _seeds(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, who, regs = [], [], []
            for _, _, buf, offsets in slices(batch.column(2)):
                for x in shingle_sets(words(buf, offsets, SPACED), k):
                    n.append(len(x))
                    who.append(x.identity())
                    regs.append(registers(x.hash, seeds).view(np.int64) if len(x) else None)
            s1, s2 = np.frombuffer(b"".join(who), np.int64).reshape(-1, 2).T.copy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.array(regs, pa.list_(pa.int64()))], ["doc_id", "th", "n", "s1", "s2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, n long, s1 long, s2 long, bands array<long>")


def _plausible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b, na, nb, ra, rb) the (a, b) that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            a, b = (np.frombuffer(c.flatten().to_numpy().tobytes(), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[4:6])
            error = np.sqrt(threshold * (1 - threshold) / a.shape[1])
            ok = estimate(a, b, na.astype(float), nb.astype(float)) >= threshold - 5 * error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, chunk: int = 64) -> DataFrame:
    """Of (a, b) those whose full sets are similar enough; a's text is sent once for each chunk of its partners."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("parts"))
    dealt = pairs.join(hubs, "a").select("a", F.expr("pmod(xxhash64(b), parts)").alias("part"), "b")
    rows = dealt.select("a", "part", F.col("b").alias("cid")).union(dealt.select("a", "part", F.col("a").alias("cid")).distinct())
    sent = rows.join(texts, "cid").select("a", "part", "cid", "text")
    sent = sent.repartition("a", "part").sortWithinPartitions("a", "part", (F.col("cid") != F.col("a")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, None
        for batch in batches:
            a, cid = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found = []
            for i, _, buf, offsets in slices(batch.column(3)):
                for at, x in enumerate(shingle_sets(words(buf, offsets, SPACED), k), i):
                    if a[at] == cid[at]:
                        hub, mine = a[at], x
                    elif hub == a[at]:
                        both = mine.shared(x)
                        if 100 * both >= percent * (len(mine) + len(x) - both):
                            found.append((hub, cid[at]))
                    else:
                        raise ValueError("a hub's text is missing")
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, texts: DataFrame, k: int, percent: int, block: int = 400_000) -> DataFrame:
    """Links (a, b) that join components: of (band, key, cid, root, n, bands), all pairs of a bucket with different roots.

    A bucket is cut into blocks of about ``block`` shingles and a task holds two blocks. It takes a pair only in its first
    common band, drops what the registers rule out, and verifies the rest on the full sets from the likeliest down,
    unless links found before have joined the two already: so it gives fewer links than it holds members.
    """
    error = 5 * np.sqrt(percent / 100 * (1 - percent / 100))
    dealt, group = block_pairs(members, ["band", "key"], F.col("n") + 200, block)
    sent = dealt.join(texts, "cid").select(*group, "block", "cid", "root", "n", "bands", "text").repartition(*group).sortWithinPartitions(*group, "cid")

    def solve(rows: pa.Table) -> list[tuple[int, int]]:
        band, lo, hi = (rows.column(c)[0].as_py() for c in (0, 2, 3))
        cid, n, block = rows.column("cid").to_pylist(), rows.column("n").to_numpy().astype(float), rows.column("block").to_numpy()
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        regs = np.ascontiguousarray(bands).view(np.uint16)
        names, root = np.unique(rows.column("root").to_numpy(), return_inverse=True)
        found: list[tuple[int, int]] = []
        sets = None
        for i in range(len(cid) - 1 if len(names) > 1 else 0):
            j = np.arange(i + 1, len(cid))
            j = j[(root[j] != root[i]) & ((block[j] != block[i]) | (lo == hi)) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            j = j[np.argmax(bands[j] == bands[i], axis=1) == band]
            if not len(j):
                continue
            like = estimate(np.broadcast_to(regs[i], (len(j), regs.shape[1])), regs[j], np.full(len(j), n[i]), n[j])
            ok = like >= percent / 100 - error / np.sqrt(regs.shape[1])
            for other in j[ok][np.argsort(-like[ok], kind="stable")].tolist():
                if root[other] == root[i]:  # joined by a pair before
                    continue
                if sets is None:
                    sets = [x for _, _, buf, o in slices(rows.column("text")) for x in shingle_sets(words(buf, o, SPACED), k)]
                both = sets[i].shared(sets[other])
                if 100 * both >= percent * (len(sets[i]) + len(sets[other]) - both):
                    root[root == root[other]] = root[i]
                    found.append((cid[i], cid[other]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, 4):
            found = solve(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """Per document (doc_id, text): n_shingles, component_id, kept, and th, the hash of the text, and root, its group (null without words)."""
    threshold = percent / 100
    sk = materialise(sketches(docs, k, bands, rows), ARROW_ROWS)
    classes = sk.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bands").alias("bands"))
    classes = materialise(classes.select("s1", "s2", "n", "rep.doc_id", "rep.th", "bands", F.monotonically_increasing_id().alias("cid")))
    banded = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("cid").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = materialise(banded.join(hubs, ["band", "key"]))
    slim = classes.select("cid", "n", "bands")
    side = lambda name: slim.select(F.col("cid").alias(name), F.col("n").alias(f"n{name}"), F.col("bands").alias(f"r{name}"))
    sized = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    stars = members.where("cid != hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    stars = stars.join(side("b"), "b").join(side("a"), "a").where(sized)
    lone = members.select("cid").distinct().join(classes.select("cid", "doc_id", "th"), "cid")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = materialise(keyed.join(lone, ["doc_id", "th"]).groupBy("cid").agg(F.first("text").alias("text")) if _repeats(sk) else keyed.join(lone, ["doc_id", "th"]).select("cid", "text"))
    links = materialise(_verified(materialise(_plausible(stars, threshold), ARROW_ROWS), texts, k, percent), ARROW_ROWS)
    roots = components(links)

    # what a star left apart: pairs of a bucket in different components, each in its first common band
    at = members.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("band", "key", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = at.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band", "key")
    apart = at.join(mixed, ["band", "key"]).join(slim, "cid")
    new = materialise(_apart(apart, texts, k, percent), ARROW_ROWS)
    if not new.isEmpty():
        roots = components(links.union(new))

    of = classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("s1", "s2", "n", "doc_id", F.coalesce("root", "cid").alias("root"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "root").select("s1", "s2", "n", "component_id", "root")
    out = sk.select("doc_id", "th", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "th", "root")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(sk: DataFrame) -> bool:
    """Whether rows of the same id and text occur."""
    return not sk.groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs, all columns, with one document of each group: the one of the smallest id; of repeated rows, one.

    Rows that share an id but not the text are judged each by its own text.
    """
    marks = near_duplicates(docs.select("doc_id", "text"), **how)
    d = docs.alias("d")
    same = lambda m: (F.col("d.doc_id") == F.col(f"{m}.doc_id")) & (F.xxhash64("d.text") == F.col(f"{m}.th"))
    drop = marks.where(~F.col("kept")).select("doc_id", "th").distinct()
    kept = d.join(drop.alias("x"), same("x"), "left_anti")
    groups = marks.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "root")
    # of rows of one id in one group the least text, once
    twice = materialise(groups.agg(F.count("*").alias("c"), F.min("th").alias("first"), F.collect_set("th").alias("ths")).where("c > 1").select("doc_id", "first", F.explode("ths").alias("th")))
    if twice.isEmpty():
        return kept
    name = "__row_" + "_".join(docs.columns)
    again = kept.alias("d").join(twice.where("th = first").alias("t"), same("t"), "left_semi").withColumn("__th" + name, F.xxhash64("text"))
    w = Window.partitionBy("doc_id", "__th" + name).orderBy(F.lit(1))
    again = again.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name, "__th" + name)
    return kept.alias("d").join(twice.alias("t"), same("t"), "left_anti").union(again)
