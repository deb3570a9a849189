"""Vector best-fit packing of tokenised documents into training sequences.

A bin has three capacities: tokens, documents and attention cost (sum of squared lengths). A piece of length L needs
(L, 1, L^2), so pieces of one length are alike and the corpus is a histogram of at most ``capacity`` lengths, whatever its
size. Lengths are placed from the longest on. Among the bins in which a piece fits under every constraint, best fit takes
the one with the smallest weighted norm of what is left in it (``rule="norm"``) or the largest weighted dot-product of
need and residual (``rule="dot"``). Bins that hold the same pieces are one group with a count, and a step fills as many
bins of a group as there are pieces for. Each step is a run of ranks; a piece finds its place by its rank in its length
(ties in length: by doc_id and piece, within hashed buckets; ties between groups of bins: the older group).

With the default document and cost capacities (as many documents as tokens, the square of the tokens) these two never
bind before the tokens do, so the number of sequences is that of best fit decreasing.

Ids come from the public byte-level BPE of the whole text; a null or empty text is the end id alone. Only documents longer than the
capacity are cut: whole pieces at the end, the first piece takes the rest. Repeated rows are packed each on its own.
Other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.llm._common import materialise, shuffle_partitions


@functools.cache
def _encoders():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str) -> list[int]:
    """The ids that tokenizers gives with byte_bpe_50k.json, without special tokens added.

    The same vocabulary's ranks give the same ids several times faster. What the two may treat differently or slowly
    goes to tokenizers itself: the special token's string, characters above U+02FF, and unbroken runs of 1,000.
    """
    fast, exact = _encoders()
    if "<|" in text or (not text.isascii() and max(text) > "˿") or len(max(text.split(" "), key=len)) >= 1000 or "    " * 100 in text:
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def tokenised_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*token_ids(text.as_py() or ""), end_id], "<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> np.ndarray:
    """Steps (length, first rank, pieces, pieces a bin, first bin, offset) that place counts[length] pieces of each length."""
    caps = np.array([capacity, max_docs, max_cost], float)
    weight = np.array(weights)
    groups: list[list] = []  # residual tokens, docs, cost; first bin; bins
    steps, bins = [], 0

    def split(g: list, k: int, length: int, n: int) -> list:
        """The first n bins of g with k pieces more."""
        new = [g[0] - k * length, g[1] - k, g[2] - k * length * length, g[3], n]
        g[3] += n
        g[4] -= n
        return new

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        cost = length * length
        need = np.array([length, 1, cost]) / caps
        fits = [g for g in groups if g[0] >= length and g[1] >= 1 and g[2] >= cost]
        if rule == "norm":
            order = [(float((weight * ((np.array(g[:3]) - [length, 1, cost]) / caps) ** 2).sum()), i) for i, g in enumerate(fits)]
        else:
            order = [(-float((weight * need * np.array(g[:3]) / caps).sum()), i) for i, g in enumerate(fits)]
        heapq.heapify(order)
        made = []
        while todo:
            opened = not order
            if opened:
                k = min(capacity // length, max_docs, max_cost // cost)
                g = [capacity, max_docs, max_cost, bins, -(-todo // k)]
                bins += g[4]
                groups.append(g)
            else:
                g = fits[heapq.heappop(order)[1]]
            # by the norm a bin that got a piece is the best again, and an opened one is the only one that fits; by the
            # dot-product it loses rank: each bin gets one before the next comparison
            k = int(min(g[0] // length, g[1], g[2] // cost)) if rule == "norm" or opened else 1
            if todo < k:
                k = todo
            n = min(todo // k, g[4])
            steps.append((length, rank, n * k, k, g[3], capacity - g[0]))
            rank += n * k
            todo -= n * k
            new = split(g, k, length, n)
            made.append(new)
            back = [new] if rule != "norm" else []
            if g[4]:
                back.append(g)
            for x in back:
                if todo and x[0] >= length and x[1] >= 1 and x[2] >= cost:
                    left = (np.array(x[:3]) - [length, 1, cost]) / caps
                    fits.append(x)
                    heapq.heappush(order, (float((weight * left**2).sum()) if rule == "norm" else -float((weight * need * np.array(x[:3]) / caps).sum()), len(fits) - 1))
        least = min(counts)
        groups = [g for g in groups + made if g[4] and g[0] >= least and g[1] and g[2] >= least * least]
    return np.array(steps, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 2048, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", per_bucket: int = 500_000) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset.

    Pieces are ranked within buckets of their length (about ``per_bucket`` rows each, however many there are), and running
    sums over the buckets' counts make the ranks whole. Pieces of full length need no rank: each is a sequence.
    """
    spark = pieces.sparkSession
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows
    for length in lengths:
        if length > capacity or length * length > max_cost:
            raise ValueError(f"a piece of {length} fits into no sequence")
    full = pieces.where(F.col("length") == capacity)
    full = full.select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = {length: n for length, n in lengths.items() if length < capacity}
    steps = plan(counts, capacity, max_docs, max_cost, rule)
    key = steps[:, 0] * 2**44 + steps[:, 1]
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], steps[order]))  # bounded by the lengths

    buckets = max(shuffle_partitions(spark), sum(counts.values()) // per_bucket, 32)
    dealt = pieces.where(F.col("length") < capacity).withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece), {buckets})"))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(base, ["length", "bucket"]).select(*pieces.columns, (F.col("base") + F.col("rank")).alias("rank"))
    at, names = {c: i for i, c in enumerate(ranked.columns)}, pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, steps = shared.value
        for batch in batches:
            length, rank = (batch.column(at[c]).to_numpy() for c in ("length", "rank"))
            s = steps[np.searchsorted(keys, length * 2**44 + rank, "right") - 1] if len(keys) else np.zeros((len(rank), 6), np.int64)
            nth = rank - s[:, 1]
            k = np.maximum(s[:, 3], 1)
            seq, offset = s[:, 4] + nth // k, s[:, 5] + nth % k * length
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return full.union(ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = 2048, **how) -> DataFrame:
    """Tokenises docs (doc_id, text), cuts what is too long, and packs."""
    return pack(materialise(tokenised_pieces(docs, capacity)), capacity, **how)
