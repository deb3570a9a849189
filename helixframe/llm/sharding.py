"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows lie in P partitions of n_p rows. Shard sizes differ by one at most. How many rows each partition sends to each shard
is one draw of the P x K matrix with those margins. It is drawn as a tree: the driver splits the shards' room among at most
``groups`` groups of partitions, and a task per group splits its room among its partitions; a hypergeometric matrix split
this way has the same law as one drawn row by row. Within its partition every row gets a place in a random permutation,
which decides its shard; rows are exchanged; and within its shard every row gets a place in a second random permutation,
its slot. So each arrangement of the rows over all places is equally likely, whatever the size.

Both permutations sort by seeded 64-bit hashes of a row number that is stored first (ties by that number), so a lost
executor changes nothing. The second one is dealt over ranges of its sort key with counted offsets, so a shard isn't one
task. A partition is what the input is read by, so one window over it has a bounded size.

A null text has size 8 and text_crc32 of the empty text, as an empty one has; texts of any length are only measured.
Repeated rows are rows of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.llm._common import materialise, shuffle_partitions

#: numpy's sampler takes fewer than that many of all kinds.
NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int, most: int = NUMPY_MOST) -> int:
    """One draw for any sizes: numpy's sampler, or inversion of probabilities that are summed from the mode outwards.

    The inverted range is 13 standard deviations and 50 either side of the mode; beyond it lie less than 1e-36.
    """
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    n = good + bad
    if n < most:
        return int(rng.hypergeometric(good, bad, draws))
    mode = (draws + 1) * (good + 1) // (n + 2)
    wide = 50 + int(13 * (draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))) ** 0.5)
    lo, hi = max(0, draws - bad, mode - wide), min(good, draws, mode + wide)
    x = np.arange(lo, hi, dtype=np.int64)
    # log of p(x + 1) / p(x)
    step = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    upto = np.cumsum(np.exp(logp - logp.max()))
    return lo + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def take(rng: np.random.Generator, room: np.ndarray, draws: int, most: int = NUMPY_MOST) -> np.ndarray:
    """How many of some draws fall to each kind: multivariate hypergeometric."""
    if int(room.sum()) < most:
        return rng.multivariate_hypergeometric(room, draws, method="marginals").astype(np.int64)
    out, left = np.zeros(len(room), np.int64), int(room.sum())
    for k, here in enumerate(room.tolist()):  # one marginal draw after the other
        left -= here
        out[k] = hypergeometric(rng, here, left, draws, most)
        draws -= int(out[k])
    return out


def split(rng: np.random.Generator, rows: list[int], room: np.ndarray, most: int = NUMPY_MOST) -> np.ndarray:
    """A random matrix of counts with these row sums and column sums (equal in total), by halves down to single rows."""
    if len(rows) == 1:
        return room[None].copy()
    half = len(rows) // 2
    first = take(rng, room, sum(rows[:half]), most)
    return np.vstack([split(rng, rows[:half], first, most), split(rng, rows[half:], room - first, most)])


def communication_matrix(rows: list[int], shards: int, seed: int, most: int = NUMPY_MOST) -> np.ndarray:
    """A random matrix of counts with these row sums and column sums that differ by one at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(rows)
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    return split(rng, rows, room, most) if rows else np.zeros((0, shards), np.int64)


def _sent(base: DataFrame, shards: int, seed: int, groups: int) -> DataFrame:
    """pid, upto: per partition the running sums of what it sends to each shard."""
    counts = base.groupBy("pid").agg(F.count("*").alias("n")).withColumn("part", F.col("pid") % groups)
    total = sorted(counts.groupBy("part").agg(F.sum("n").alias("n")).collect())  # groups at most
    matrix = communication_matrix([r.n for r in total], shards, seed)
    room = base.sparkSession.createDataFrame([(r.part, m.tolist()) for r, m in zip(total, matrix, strict=True)], "part int, room array<long>")

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        rng = np.random.Generator(np.random.PCG64([seed, int(key[0])]))
        own = split(rng, pdf["n"].tolist(), np.array(pdf["room"].iloc[0], np.int64))
        return pd.DataFrame({"pid": pdf["pid"], "upto": list(np.cumsum(own, axis=1))})

    return counts.join(F.broadcast(room), "part").groupBy("part").applyInPandas(draw, "pid int, upto array<long>")


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 20240607, groups: int = 1024) -> DataFrame:
    """Per document (doc_id, text): size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("pid"))
    base = materialise(base.withColumn("size", F.coalesce("size", F.lit(8).cast("long"))))
    # both sides of the join lie by pid, so the rows of a partition move once
    sent = materialise(_sent(base, shards, seed, groups))
    first = F.row_number().over(Window.partitionBy("pid").orderBy(F.xxhash64("rid", F.lit(seed)), "rid")) - 1
    dealt = base.withColumn("place", first).join(sent, "pid")
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("place"))))
    dealt = dealt.withColumn("mix", F.xxhash64("rid", F.lit(seed + 1), F.lit("slot")))
    parts = min(1024, max(2, -(-shuffle_partitions(spark) * 2 // shards)))
    dealt = materialise(dealt.withColumn("range", F.shiftrightunsigned(F.col("mix"), 33) * parts / F.lit(2**31)).withColumn("range", F.floor("range").cast("int")).select("doc_id", "size", "text_crc32", "rid", "shard", "range", "mix"))

    offsets, at = [], {}
    for r in sorted(dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()):  # shards * 1024 at most
        offsets.append((r.shard, r.range, at.get(r.shard, 0)))
        at[r.shard] = at.get(r.shard, 0) + r.n
    start = spark.createDataFrame(offsets, "shard int, range int, start long")
    second = F.row_number().over(Window.partitionBy("shard", "range").orderBy("mix", "rid")) - 1
    placed = dealt.withColumn("in_range", second).join(F.broadcast(start), ["shard", "range"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("in_range")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
