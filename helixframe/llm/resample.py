"""Importance resampling towards a target: hashed word n-grams weigh each document by how much likelier the target makes it.

Features are runs of 1 to 2 consecutive words, joined by one space. They are hashed where the text lies: the bytes of an
Arrow buffer are classified by a lookup table, words begin and end where neighbouring classes differ, and a table-driven
CRC-32 steps through the bytes of all words at once, a register each, so step j is one array operation over the words of
more than j bytes. A pair's register goes on from its first word's. Counts of buckets are summed in each task before they
are shuffled. The gains of the buckets are one array of ``buckets`` numbers, the only thing that is broadcast.

Documents with at least ``least_words`` words compete: log weight plus Gumbel noise from a hash of the id draws without
replacement. Scores are whole numbers in a range of less than 200,000 values whatever the table holds, so their histogram gives
each score's first rank, and only rows of one score are sorted together.

Null and wordless texts have no features, weight 0 and no rank. A null doc_id takes the hash of no digits and ranks first
among ties; repeated rows are ranked each, ties of one id by the order in which they were stored. Words of more than
``LONG`` bytes are finished by zlib. An empty target or corpus gives gains of the other's counts alone; an empty table no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.llm._common import materialise
from helixframe.llm._text import ALNUM, Words, slices, word_bounds

LONG = 128


def _table() -> np.ndarray:
    """The reflected CRC-32 of each byte, polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


TABLE = _table()
_ONES = np.uint32(0xFFFFFFFF)


def advance(register: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes low[start:end], all words at once."""
    size = end - start
    order = np.argsort(-size, kind="stable")  # those of more than j bytes come first
    r, at = register[order], start[order]
    live = len(size) - np.cumsum(np.bincount(np.minimum(size, LONG), minlength=LONG + 1))
    for j in range(LONG):
        m = live[j]
        if not m:
            break
        r[:m] = TABLE[(r[:m] ^ low[at[:m] + j]) & np.uint32(255)] ^ (r[:m] >> np.uint32(8))
    for i in range(int((size > LONG).sum())):
        r[i] = zlib.crc32(low[at[i] + LONG : end[order[i]]].tobytes(), int(r[i] ^ _ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(r)
    out[order] = r
    return out


def features(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word; bucket of each word with the next, -1 for the last word of a text."""
    one = advance(np.full(len(w.start), _ONES, np.uint32), w.low, w.start, w.end)
    pairs = np.full(len(one), -1, np.int64)
    has = np.ones(len(one), bool)
    ends = w.first[1:][np.diff(w.first) > 0] - 1
    has[ends] = False
    at = np.flatnonzero(has)
    spaced = TABLE[(one[at] ^ np.uint32(32)) & np.uint32(255)] ^ (one[at] >> np.uint32(8))
    two = advance(spaced, w.low, w.start[at + 1], w.end[at + 1])
    pairs[at] = (two ^ _ONES) % np.uint32(buckets)
    return ((one ^ _ONES) % np.uint32(buckets)).astype(np.int64), pairs


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: features of all texts, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0)):
                for found in features(word_bounds(buf, offsets, ALNUM), buckets):
                    total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """By bucket: floor(1000 ln of the smoothed ratio of the target's share and the source's)."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, texts in ((s, source), (t, target)):
        for r in bucket_counts(texts, buckets).collect():  # a row a bucket at most
            into[r.bucket] = r.n
    more, less = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log(((b + 1) * more) / ((a + 1) * less))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight of each document."""
    own = docs.sparkSession.sparkContext.broadcast(gain)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for _, _, buf, offsets in slices(batch.column(1)):
                w = word_bounds(buf, offsets, ALNUM)
                one, two = features(w, buckets)
                here = own.value[one] + np.where(two >= 0, own.value[two], 0)
                upto = np.concatenate([[0], np.cumsum(here)])
                total, words_ = upto[w.first[1:]] - upto[w.first[:-1]], w.counts()
                k = np.maximum(0, 2 * words_ - 1)
                n.append(k)
                weight.append(np.where(k > 0, total // np.maximum(k, 1), 0))
            columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (n, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Per document (doc_id, text): n_features, weight, score, rank (null unless drawn)."""
    weighed = weights(docs, gains(docs, target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = materialise(weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("rid", F.monotonically_increasing_id()))
    enough = F.col("n_features") >= 2 * least_words - 1
    by_score = materialise(rows.where(enough).groupBy("score").agg(F.count("*").alias("n")))
    drawn = percent * (by_score.agg(F.sum("n")).first()[0] or 0) // 100
    # at most a row for each possible score
    upto = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    first = by_score.withColumn("ahead", upto - F.col("n")).where(F.col("ahead") < drawn).select("score", "ahead")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "rid"))
    ranked = rows.where(enough).join(F.broadcast(first), "score").withColumn("rank", F.col("ahead") + place)
    ranks = ranked.where(F.col("rank") <= drawn).select("rid", "rank")
    return rows.join(ranks, "rid", "left").select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
