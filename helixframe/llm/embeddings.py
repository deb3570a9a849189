"""Near-duplicate vectors with randomised-rotation binary codes.

A unit vector is rotated at random, twice; its two codes are the signs, and each stored correction factor is the inner
product of the rotated vector with its own code. A code over its factor, turned back, estimates the vector's inner product
with anything without bias; so do the first code of one vector and the second of another, whose rotations are independent,
and the mean of both ways. The factors bound the error. The share of signs that agree, an estimate of the angle, bounds it
once more.

Vectors meet in tables keyed by sign bits of further rotations; the number of bits follows the number of vectors (buckets
of about ``bucket``), the number of tables the wanted ``miss`` probability of a pair at the threshold itself. Only codes and
factors are sent to the tables. There the estimates decide which pairs need the exact cosine (those less than 5 standard
errors below the threshold), and only vectors with such a pair follow, to be multiplied exactly. A link counts in the first
table in which its two vectors meet, and a task reports sums and the links that join its components only, so no bucket
emits its pairs. Large buckets are dealt to pairs of blocks.

Equal vectors form one class first (known by 128 bits). Null vectors, zero vectors and those with null or non-finite
components have no links: n_links 0, their own component, kept. Vectors of different lengths are never linked. Labels are
ignored. A cosine of exactly the threshold links. Repeated vec_ids are rows of their own, counted as vectors; ties of a
component go to the smallest vec_id. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._common import block_pairs, by_group, components, materialise

SIGMAS = 5.0


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """At least count rows of stacked random rotations."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return np.vstack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-count // dim))])[: max(count, dim)]


class Tables:
    def __init__(self, vectors: int, threshold: float, bucket: int, miss: float, seed: int = 11):
        same = 1 - math.acos(threshold) / math.pi  # chance that two vectors at the threshold share a sign
        self.bits = min(60, max(2, math.ceil(math.log2(max(vectors, 1) / bucket)) if vectors > bucket else 2))
        self.count = max(1, math.ceil(math.log(miss) / math.log(1 - same**self.bits)))
        self.seed, self.threshold, self._by = seed, threshold, {}

    def _rotation(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if dim not in self._by:
            self._by[dim] = rotations(dim, dim, self.seed), rotations(dim, dim, self.seed + 2), rotations(dim, self.bits * self.count, self.seed + 1)[: self.bits * self.count]
        return self._by[dim]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Per vector its key in each table."""
        signs = (unit @ self._rotation(unit.shape[1])[2].T > 0).reshape(len(unit), self.count, self.bits)
        return signs @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Per vector the bytes of its two codes, each behind its correction factor."""
        parts = []
        for turn in self._rotation(unit.shape[1])[:2]:
            turned = unit @ turn.T
            factor = (np.abs(turned).sum(1) / math.sqrt(unit.shape[1])).astype("<f4")
            parts += [factor.view(np.uint8).reshape(-1, 4), np.packbits(turned > 0, axis=1)]
        return np.hstack(parts)

    def vectors(self, codes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two estimates of each vector from its codes, the signs of both codes, and the smaller factor."""
        size, out, low, signs = 4 + (dim + 7) // 8, [], [], []
        for i, turn in enumerate(self._rotation(dim)[:2]):
            part = np.ascontiguousarray(codes[:, i * size : (i + 1) * size])
            low.append(np.maximum(np.ascontiguousarray(part[:, :4]).view("<f4")[:, 0].astype(np.float64), 1e-3))
            signs.append(np.unpackbits(part[:, 4:], axis=1)[:, :dim].astype(np.float32) * 2 - 1)
            out.append((signs[-1] @ turn / (math.sqrt(dim) * low[-1][:, None])).astype(np.float32))
        return out[0], out[1], np.hstack(signs), np.minimum(*low)

    def error(self, factor: np.ndarray, dim: int) -> np.ndarray:
        """Standard error of estimates at the threshold between vectors of each factor; of a pair, the larger one bounds it."""
        f2, t2 = factor * factor, self.threshold * self.threshold
        return np.sqrt(np.maximum(1 - f2, 0) / f2 * (1 / f2 - t2 + 1 - t2) / max(dim - 1, 1)).astype(np.float32)

    def candidates(self, codes: np.ndarray, dim: int, apart: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, that both estimates leave in doubt; apart: of different blocks only, where given."""
        x, y, signs, factor = self.vectors(codes, dim)
        bound = np.float32(self.threshold - 1e-5) - np.float32(SIGMAS) * self.error(factor, dim)
        p = math.acos(self.threshold) / math.pi  # share of signs that differ at the threshold
        agree = 2 * dim * (1 - 2 * p) - SIGMAS * 2 * math.sqrt(2 * dim * p * (1 - p))
        for a in range(0, len(x), 256):
            b = min(a + 256, len(x))
            ok = signs[a:b] @ signs[a:].T >= agree
            ok &= (x[a:b] @ y[a:].T + y[a:b] @ x[a:].T) / 2 >= np.minimum(bound[a:b, None], bound[None, a:])
            if apart is not None:
                ok &= apart[a:b, None] != apart[None, a:]
            i, j = np.nonzero(np.triu(ok, 1))
            if len(i):
                yield i + a, j + a


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """A column of binaries of one size as rows of bytes."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), -1)


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, bucket: int = 200, miss: float = 1e-4, block: int = 2048) -> DataFrame:
    """Per row (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    every = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = finite & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    every = every.withColumn("v", F.when(good, F.col("v"))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v", F.size("v")))
    classes = every.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()))
    tables = spark.sparkContext.broadcast(Tables(classes.count(), threshold, bucket, miss))

    def matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of each length and their vectors."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
        begin = np.cumsum(size) - size
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            yield at, flat[begin[at][:, None] + np.arange(d)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in matrix(batch.column(1)):
                unit = _unit(vectors)
                codes, keys = tables.value.codes(unit), tables.value.keys(unit)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), unit.shape[1], np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["cid", "dim", "code", "keys"])

    coded = materialise(classes.select("cid", "v").mapInArrow(code, "cid long, dim int, code binary, keys array<long>"))
    light = coded.select("cid", "code", "dim", F.posexplode("keys").alias("t", "key"))
    dealt, group = block_pairs(light, ["t", "dim", "key"], F.lit(1), block)
    sent = dealt.select(*group, "block", "cid", "code").repartition(*group).sortWithinPartitions(*group, "cid")

    def blocks(rows: pa.Table) -> np.ndarray | None:
        return None if rows.column("lo")[0] == rows.column("hi")[0] else rows.column("block").to_numpy()

    def doubt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a group that have a pair in doubt."""
        for rows in by_group(batches, 5):
            some = np.zeros(len(rows), bool)
            if len(rows) > 1:
                for i, j in tables.value.candidates(_bytes(rows.column("code")), rows.column("dim")[0].as_py(), blocks(rows)):
                    some[i] = some[j] = True
            yield from rows.filter(pa.array(some)).to_batches()

    kinds = "t int, dim int, key long, lo int, hi int, block int, cid long, code binary"
    kept = sent.mapInArrow(doubt, kinds)
    follow = kept.join(classes.select("cid", "m", "v"), "cid").select(*group, "block", "cid", "code", "m", "v").repartition(*group).sortWithinPartitions(*group, "cid")

    def solve(rows: pa.Table) -> pa.RecordBatch:
        t = tables.value
        nth, dim = (rows.column(c)[0].as_py() for c in ("t", "dim"))
        cid, m = (rows.column(c).to_numpy() for c in ("cid", "m"))
        unit = _unit(rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(cid), dim))
        keys = t.keys(unit)
        links, above, found = np.zeros(len(cid), np.int64), list(range(len(cid))), []

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for i, j in t.candidates(_bytes(rows.column("code")), dim, blocks(rows)):
            for c in range(0, len(i), 1 << 17):
                x, y = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
                first = np.argmax(keys[x] == keys[y], axis=1) == nth
                x, y = x[first], y[first]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= t.threshold
                x, y = x[near], y[near]
                links += np.bincount(x, m[y], len(cid)).astype(np.int64) + np.bincount(y, m[x], len(cid)).astype(np.int64)
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    p0, q0 = top(p), top(q)
                    if p0 != q0:
                        above[p0] = q0
                        found.append((cid[p], cid[q]))
        some = np.flatnonzero(links)
        n = len(found)
        left, right = [f[0] for f in found], [f[1] for f in found]
        return pa.RecordBatch.from_arrays([pa.array([*cid[some].tolist(), *left], pa.int64()), pa.array([*[None] * len(some), *right], pa.int64()), pa.array([*links[some].tolist(), *[0] * n], pa.int64())], ["a", "b", "n"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, 5):
            yield solve(rows)

    told = materialise(follow.mapInArrow(exact, "a long, b long, n long"))
    links = told.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(told.where("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
    of = classes.select("cid", "h1", "h2", "least", "m").join(roots, "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(least, "root").select("h1", "h2", "component_id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = every.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("ok")).join(of, ["h1", "h2"], "left")
    own = F.when(F.col("ok"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
