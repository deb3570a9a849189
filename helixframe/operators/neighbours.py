"""Neighbour search over (id, vec), neighbour graphs, batch mixing, batch correction, neighbourhood sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.functions.columns import unit
from helixframe.functions.special import chi2_sf_col
from helixframe.plans.checkpoint import cut, scratch

METRICS = ("euclidean", "cosine")
METHODS = ("exhaustive", "lsh", "annoy", "ivf", "nndescent")
#: Vectors that partitions of the space are fitted on; every vector is indexed.
SAMPLE = 20_000
#: Blocks that a table is dealt to for all pairs, and rows of a block beyond which there are more: a row is sent once for each
#: block of the other side, so that what is shuffled grows with the rows as long as blocks are large enough.
BLOCKS, LARGEST = 12, 131_072
#: Distances held at a time, and how far apart two may be that the twelve digits of an order can make equal.
AT_ONCE, TIE = 1 << 22, 2e-12
#: Width of vectors up to which boxes of space leave out most pairs, and rows of a box.
LOW, IN_BOX = 3, 2048


def _blocks(rows: int, block: int) -> int:
    return max(1, min(-(-rows // block), max(BLOCKS, -(-rows // LARGEST))))


def _ready(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows made unit for the cosine, and their squares."""
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return x, (x * x).sum(1)


def _between(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1 - a[0] @ b[0].T
    if a[0].shape[1] <= LOW:  # squares and products of large numbers would leave digits of small distances behind
        return np.sqrt(sum((x[:, None] - y[None]) ** 2 for x, y in zip(a[0].T, b[0].T, strict=True)))
    sq = a[1][:, None] + b[1][None] - 2 * a[0] @ b[0].T
    return np.sqrt(np.maximum(sq, 0))


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return _between(_ready(a, metric), _ready(b, metric), metric)


def _best_of(a: tuple, ids: np.ndarray, b: tuple, names: np.ndarray, k: int, metric: str, own: bool) -> Iterator[pd.DataFrame]:
    """id, nbr, dist: for each row of a the k nearest of b and what ties with the last; so many rows of a at a time that AT_ONCE distances are held."""
    step = max(1, min(1024, AT_ONCE // len(names)))
    for i in range(0, len(ids), step):
        d = _between((a[0][i : i + step], a[1][i : i + step]), b, metric)
        if own:
            d[ids[i : i + step][:, None] == names[None]] = np.inf
        m = min(k, d.shape[1])
        at = np.argpartition(d, m - 1, axis=1)[:, :m]
        # ties at the border must stay for the merge to break them by id
        edge = np.take_along_axis(d, at, 1).max(1)
        row, col = np.nonzero((d <= edge[:, None] + TIE) & np.isfinite(d))
        nbr, dist = names[col], d[row, col]
        if len(row) > 2 * k * len(d):  # of many at one distance those of the k smallest ids
            order = np.lexsort((nbr, dist, row))
            row, nbr, dist = row[order], nbr[order], dist[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (dist[1:] != dist[:-1])])
            few = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
            row, nbr, dist = row[few], nbr[few], dist[few]
        yield pd.DataFrame({"id": ids[i : i + step][row], "nbr": nbr, "dist": dist})


def knn(query: DataFrame, k: int, metric: str = "cosine", reference: DataFrame | None = None, block: int = 4096, method: str = "exhaustive", seed: int = 42, aim: float = 0.97) -> DataFrame:
    """id, rank (from 1), nbr, dist: the k nearest of the reference (of the table itself without it, self left out by id).

    Exhaustive: both tables are dealt to blocks, each pair of blocks is one matrix product that keeps k per query, and
    the best k of those are merged; many short vectors of one table by boxes of space instead, as exactly. The others are approximate and look at parts of the reference: lsh at buckets of random
    hyperplanes, annoy at the leaves of a forest of median splits, ivf at the cells of the nearest centroids, as many of
    each as bring a share ``aim`` of true neighbours within a sample; nndescent improves neighbour lists by their neighbours'
    neighbours (within one table only).
    """
    metric, method = metric.lower(), method.lower()
    if metric not in METRICS or method not in METHODS:
        raise ValueError("unknown metric or method")
    own = reference is None
    reference = query if own else reference
    q, r = query.select("id", "vec"), reference.select("id", "vec")
    if method == "exhaustive":
        rows = q.count()
        if own and metric == "euclidean" and rows > 4 * IN_BOX >= 64 * k and len(q.select("vec").first().vec) <= LOW:
            return _boxed(q, k, rows, seed)
        nq, nr = _blocks(rows, block), _blocks(r.count(), block)
        q = q.withColumn("qb", F.expr(f"pmod(xxhash64(id), {nq})")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)).cast("array<bigint>")))
        r = r.withColumn("rb", F.expr(f"pmod(xxhash64(id, 1), {nr})")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))
    elif method == "nndescent":
        if not own:
            raise ValueError("nndescent searches a table within itself")
        return _descent(q, k, metric, seed)
    else:
        if metric == "cosine":
            q, r = (x.withColumn("vec", unit(F.col("vec"))) for x in (q, r))
        if method == "ivf":
            centre, probes = fitted_cells(_sample(r, seed), r.count(), seed, aim=aim)
            placed = _keyed(r, _near_cells(centre, 1)).select("id", "vec", F.col("rb").alias("cell"))
            return _shelved(q, placed, centre, probes, k, metric, own, block)
        q, r = _buckets(q, r, seed) if method == "lsh" else _leaves(q, r, seed, aim=aim)
    return _nearest(q, r, k, metric, own, method != "exhaustive")


def _nearest(q: DataFrame, r: DataFrame, k: int, metric: str, own: bool, repeats: bool) -> DataFrame:
    """id, rank, nbr, dist of (id, vec, qb, rb) tables: the k nearest of those that share a group; own: an id is no neighbour of itself.

    repeats: whether a pair may share several groups.
    """
    kind = q.schema["id"].dataType.simpleString()
    # the two sides may share their lineage: own names keep them apart
    r = r.select(F.col("id").alias("rid"), F.col("vec").alias("rvec"), F.col("qb").alias("rqb"), F.col("rb").alias("rrb"))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["id", "nbr", "dist"])
        a, b = (_ready(np.array(x.tolist(), float), metric) for x in (left["vec"], right["rvec"]))
        return pd.concat(_best_of(a, left["id"].to_numpy(), b, right["rid"].to_numpy(), k, metric, own))

    found = q.groupBy("qb", "rb").cogroup(r.groupBy("rqb", "rrb")).applyInPandas(near, f"id {kind}, nbr {kind}, dist double")
    return _ranked(found.dropDuplicates(["id", "nbr"]) if repeats else found, k)


def _boxed(points: DataFrame, k: int, rows: int, seed: int) -> DataFrame:
    """id, rank, nbr, dist of short vectors, exactly: boxes of about IN_BOX points come from median splits of a sample.

    A point meets its own box first; its k nearest there bound how far others may be, and it is sent to the boxes within that.
    """
    kind = points.schema["id"].dataType.simpleString()
    points = points.where(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    x = _sample(points, seed)
    nodes: list[tuple[int, float, int, int]] = []  # axis, where it is cut, and the nodes of both sides; an axis of -1 is a box

    def grow(own: np.ndarray, depth: int) -> int:
        at, axis = len(nodes), int(np.ptp(own, axis=0).argmax()) if len(own) else 0
        middle = float(np.median(own[:, axis])) if len(own) else 0.0
        low = own[:, axis] <= middle
        nodes.append((-1, 0.0, 0, 0))
        if depth and len(own) > 1 and not low.all():
            nodes[at] = (axis, middle, grow(own[low], depth - 1), grow(own[~low], depth - 1))
        return at

    grow(x, max(1, math.ceil(math.log2(max(rows / IN_BOX, 2)))))
    axis, middle, left, right = (np.array(c) for c in zip(*nodes, strict=True))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf["vec"].tolist(), float)
                node, every = np.zeros(len(v), int), np.arange(len(v))
                while (axis[node] >= 0).any():
                    inner = axis[node]
                    node = np.where(inner < 0, node, np.where(v[every, inner] <= middle[node], left[node], right[node]))
                yield pdf.assign(box=node)

    placed = cut(points.mapInPandas(place, f"id {kind}, vec array<double>, box int"))
    ends = placed.groupBy("box").agg(*[f(F.col("vec")[i]).alias(f"{n}{i}") for i in range(x.shape[1]) for n, f in (("low", F.min), ("high", F.max))]).toPandas()
    boxes, low, high = ends["box"].to_numpy(), *(ends[[f"{n}{i}" for i in range(x.shape[1])]].to_numpy(float) for n in ("low", "high"))

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids, home = np.array(pdf["vec"].tolist(), float), pdf["id"].to_numpy(), pdf["box"].iloc[0]
        a = _ready(v, "euclidean")
        found = pd.concat(_best_of(a, ids, a, ids, k, "euclidean", True))
        order = found.sort_values(["id", "dist"], ignore_index=True)
        last = order[order.groupby("id").cumcount() == k - 1].set_index("id")["dist"].reindex(ids).fillna(np.inf).to_numpy()
        out, step = [found.assign(box=-1, vec=None, last=0.0)], max(1, AT_ONCE // len(boxes))
        for i in range(0, len(v), step):
            own = v[i : i + step, None]
            gap = np.sqrt((np.maximum(np.maximum(low[None] - own, own - high[None]), 0) ** 2).sum(2))
            row, to = np.nonzero((gap <= last[i : i + step, None] * (1 + TIE) + TIE) & (boxes != home)[None])
            out.append(pd.DataFrame({"id": ids[i + row], "nbr": ids[i + row], "dist": 0.0, "box": boxes[to], "vec": list(v[i + row]), "last": last[i + row]}))
        return pd.concat([o for o in out if len(o)])

    first = cut(placed.groupBy("box").applyInPandas(at_home, f"id {kind}, nbr {kind}, dist double, box int, vec array<double>, last double"))

    def away(guests: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(guests) or not len(own):
            return pd.DataFrame(columns=["id", "nbr", "dist"])
        a, b = (_ready(np.array(p["vec"].tolist(), float), "euclidean") for p in (guests, own))
        last = pd.Series(guests["last"].to_numpy(), guests["id"].to_numpy())
        found = (f[f["dist"].to_numpy() <= last.reindex(f["id"]).to_numpy() * (1 + TIE) + TIE] for f in _best_of(a, guests["id"].to_numpy(), b, own["id"].to_numpy(), k, "euclidean", True))
        return pd.concat(found)

    met = first.where("box >= 0").groupBy("box").cogroup(placed.groupBy("box")).applyInPandas(away, f"id {kind}, nbr {kind}, dist double")
    return _ranked(first.where("box < 0").select("id", "nbr", "dist").union(met), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.round("dist", 12), "nbr")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "nbr", "dist")


def _buckets(q: DataFrame, r: DataFrame, seed: int, tables: int = 12, per: int = 256) -> tuple[DataFrame, DataFrame]:
    n = r.count()
    bits = max(1, math.ceil(math.log2(max(n / per, 2))))
    dim = len(r.select("vec").first().vec)
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))
    mean = np.array(r.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").toPandas()["v"])

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vec"].tolist(), float) - mean
                sign = np.einsum("tbd,nd->ntb", planes, x) > 0
                yield pdf.assign(keys=list((sign @ (1 << np.arange(bits))).astype(np.int64)))

    kind = r.schema["id"].dataType.simpleString()
    out = []
    for df in (q, r):
        keyed = df.mapInPandas(key, f"id {kind}, vec array<double>, keys array<long>")
        out.append(keyed.select("id", "vec", F.posexplode("keys").alias("qb", "rb")))
    return out[0], out[1]


def _sample(r: DataFrame, seed: int) -> np.ndarray:
    """At most SAMPLE vectors, those of the smallest hash of their id."""
    rows = r.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vec").collect()
    return np.array([x.vec for x in rows], float)


def _keyed(df: DataFrame, keys) -> DataFrame:
    """id, vec, qb, rb: a row for each key, rb, that keys gives to a vector, qb its place; keys: vectors to arrays of numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(keys=keys(np.array(pdf["vec"].tolist(), float)))

    kind = df.schema["id"].dataType.simpleString()
    out = df.mapInPandas(run, f"id {kind}, vec array<double>, keys array<long>")
    return out.select("id", "vec", F.posexplode("keys").alias("qb", "rb"))


def _true_pairs(x: np.ndarray, seed: int, queries: int = 256, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Some vectors of the sample and, beside each, its k nearest in the sample: what an index has to bring together."""
    own = np.random.default_rng([seed, 1]).choice(len(x), min(queries, len(x)), replace=False)
    d = _distances(x[own], x, "euclidean")
    d[np.arange(len(own)), own] = np.inf
    k = min(k, len(x) - 1)
    return np.repeat(own, k), np.argsort(d, axis=1, kind="stable")[:, :k].ravel()


def _leaves(q: DataFrame, r: DataFrame, seed: int, aim: float = 0.97, most: int = 64, per: int = 128) -> tuple[DataFrame, DataFrame]:
    """Leaves of trees that split the sample at the median between two random points of each node.

    Trees are added until a share ``aim`` of the sample's true neighbours meet in a leaf, up to ``most``.
    """
    x = _sample(r, seed)
    depth = max(1, math.ceil(math.log2(max(r.count() / per, 2))))
    rng = np.random.default_rng(seed)
    a_side, b_side = _true_pairs(x, seed)
    met, normals, cuts = np.zeros(len(a_side), bool), [], []
    while len(normals) < most and (not normals or met.mean() < aim):
        normal, at, leaf = np.zeros((2**depth, x.shape[1])), np.zeros(2**depth), np.zeros(len(x), np.int64)
        members = {1: np.arange(len(x))}
        for node in range(1, 2**depth):
            own = members.pop(node)
            a, b = x[rng.choice(own if len(own) > 1 else len(x), 2)]
            normal[node] = a - b
            side = x[own] @ normal[node]
            at[node] = np.median(side) if len(own) else 0.0
            members[2 * node], members[2 * node + 1] = own[side <= at[node]], own[side > at[node]]
        for node, own in members.items():
            leaf[own] = node
        met |= leaf[a_side] == leaf[b_side]
        normals.append(normal)
        cuts.append(at)
    normal, at, trees = np.array(normals), np.array(cuts), len(normals)

    def keys(v: np.ndarray) -> list:
        node = np.ones((len(v), trees), np.int64)
        each = np.arange(trees)
        for _ in range(depth):
            side = np.einsum("ntd,nd->nt", normal[each, node], v)
            node = 2 * node + (side > at[each, node])
        return list(node)

    return _keyed(q, keys), _keyed(r, keys)


def fitted_cells(x: np.ndarray, n: int, seed: int, probes: int | None = None, rounds: int = 10, aim: float = 0.97) -> tuple[np.ndarray, int]:
    """About sqrt(n) centroids of a sample, and in how many of its nearest cells a query has to look.

    Without a number of probes it is as many as bring a share ``aim`` of the sample's true neighbours.
    """
    lists = max(1, min(int(math.sqrt(n)), len(x)))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        label = _distances(x, centre, "euclidean").argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, label, x)
        size = np.bincount(label, minlength=lists)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    if probes is None:
        a, b = _true_pairs(x, seed)
        d = _distances(x[a], centre, "euclidean")
        home = _distances(x[b], centre, "euclidean").argmin(1)
        rank = (d < d[np.arange(len(a)), home][:, None]).sum(1)
        probes = int(np.quantile(rank, aim)) + 1 if len(rank) else 1
    return centre, min(lists, probes)


def _near_cells(centre: np.ndarray, m: int):
    return lambda v: list(np.argsort(_distances(v, centre, "euclidean"), axis=1, kind="stable")[:, :m])


def _shelved(q: DataFrame, r: DataFrame, centre: np.ndarray, probes: int, k: int, metric: str, own: bool, block: int) -> DataFrame:
    """The k nearest of q(id, vec) among r(id, vec, cell) in the cells of each query's nearest centroids.

    Cells are dealt to at most BLOCKS shelves. A query is sent once to a shelf with the bits of the cells it looks into there,
    and leaves it with its k best of them; shelves are sent once for each block of queries.
    """
    shelves, nq = min(len(centre), BLOCKS), _blocks(q.count(), block)
    per, every = -(-len(centre) // shelves), _near_cells(centre, probes)
    kind = q.schema["id"].dataType.simpleString()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            cells = np.array(every(np.array(pdf["vec"].tolist(), float)))
            seen = np.zeros((len(pdf), shelves, per), bool)
            seen[np.arange(len(pdf))[:, None], cells % shelves, cells // shelves] = True
            bits, some = np.packbits(seen, axis=2), seen.any(2)
            yield pdf.assign(bits=[[x.tobytes() if ok else None for x, ok in zip(row, has, strict=True)] for row, has in zip(bits, some, strict=True)])

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["id", "nbr", "dist"])
        if not len(left) or not len(right):
            return none
        a, b = (_ready(np.array(x.tolist(), float), metric) for x in (left["vec"], right["rvec"]))
        ids, names, place = left["id"].to_numpy(), right["rid"].to_numpy(), right["cell"].to_numpy() // shelves
        seen = np.unpackbits(np.frombuffer(b"".join(left["bits"]), np.uint8).reshape(len(left), -1), axis=1)
        kept, held = [], 0

        def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
            out = pd.concat(parts).sort_values(["id", "dist"], ignore_index=True)
            first = np.flatnonzero(np.r_[True, out["id"].to_numpy()[1:] != out["id"].to_numpy()[:-1]])
            size = np.diff(np.r_[first, len(out)])
            edge = out["dist"].to_numpy()[first + np.minimum(size, k) - 1]
            return out[out["dist"].to_numpy() <= np.repeat(edge, size) + TIE]

        for cell in np.unique(place):
            mine, at = np.flatnonzero(place == cell), np.flatnonzero(seen[:, cell])
            if not len(at):
                continue
            for part in _best_of((a[0][at], a[1][at]), ids[at], (b[0][mine], b[1][mine]), names[mine], k, metric, own):
                kept.append(part)
                held += len(part)
            if held > AT_ONCE:
                kept = [best(kept)]
                held = len(kept[0])
        return best(kept) if kept else none

    looks = q.mapInPandas(look, f"id {kind}, vec array<double>, bits array<binary>").select("id", "vec", F.expr(f"pmod(xxhash64(id), {nq})").alias("qb"), F.posexplode("bits").alias("rb", "bits")).where("bits is not null")
    shelf = r.select(F.col("id").alias("rid"), F.col("vec").alias("rvec"), "cell", F.pmod("cell", F.lit(shelves)).cast("int").alias("rrb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")).alias("rqb"))
    found = looks.groupBy("qb", "rb").cogroup(shelf.groupBy("rqb", "rrb")).applyInPandas(near, f"id {kind}, nbr {kind}, dist double")
    return _ranked(found, k)


def save_index(points: DataFrame, path: str, metric: str = "cosine", probes: int | None = None, aim: float = 0.97, block: int = 4096, seed: int = 42) -> None:
    """An index of (id, vec) in a folder: vectors sorted by cell, in parts of about ``block`` where a cell has more; and the cells."""
    metric = metric.lower()
    if metric not in METRICS:
        raise ValueError("unknown metric")
    r = points.select("id", "vec")
    if metric == "cosine":
        r = r.withColumn("vec", unit(F.col("vec")))
    r = cut(r)
    centre, probes = fitted_cells(_sample(r, seed), r.count(), seed, probes, aim=aim)
    placed = cut(_keyed(r, _near_cells(centre, 1)).select("id", "vec", F.col("rb").alias("cell")))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.expr("int(pmod(xxhash64(id), parts))")).drop("parts")
    dealt.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{path}/vectors")
    spark = points.sparkSession
    cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], "cell long, centre array<double>")
    cells.join(sizes, "cell", "left").na.fill(0, ["parts"]).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(metric, probes)], "metric string, probes int").write.mode("overwrite").parquet(f"{path}/about")


def search_index(spark, path: str, query: DataFrame, k: int, probes: int | None = None, own: bool = False) -> DataFrame:
    """id, rank, nbr, dist: the k nearest vectors of a saved index; own: the query's ids are the index's, and none is its own neighbour.

    probes: cells that a query looks into, as many as the index was saved with by default; all of them make it exact.
    """
    about = spark.read.parquet(f"{path}/about").first()
    cells = spark.read.parquet(f"{path}/cells")
    rows = cells.orderBy("cell").collect()  # at most a row a vector of the sample
    centre = np.array([r.centre for r in rows], float)
    q = query.select("id", "vec")
    if about.metric == "cosine":
        q = q.withColumn("vec", unit(F.col("vec")))
    r = spark.read.parquet(f"{path}/vectors").select("id", "vec", "cell")
    return _shelved(q, r, centre, min(len(rows), probes or about.probes), k, about.metric, own, 4096)


def _descent(points: DataFrame, k: int, metric: str, seed: int, rounds: int = 6, wide: int = 2) -> DataFrame:
    """Neighbour lists from the leaves of a few trees, improved by the neighbours, both ways, of neighbours."""
    m = wide * k
    vec = cut(points.select("id", "vec"))

    def best(pairs: DataFrame) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.round("dist", 12), "nbr")
        return cut(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m))

    kind = points.schema["id"].dataType.simpleString()
    buckets = max(1, vec.count() // 256)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of each via the pairs of who lists it and whom it lists, one link of them new, that a list of the former has room for."""
        out = [pd.DataFrame(columns=["id", "nbr", "dist"])]
        if not len(left) or not len(right):
            return out[0]
        left, right = left.sort_values("via", ignore_index=True), right.sort_values("at", ignore_index=True)
        a, b = (_ready(np.array(x.tolist(), float), metric) for x in (left["vec"], right["other"]))
        ids, names, worst = left["id"].to_numpy(), right["nbr"].to_numpy(), left["worst"].to_numpy(float)
        new_a, new_b, via, at = left["new"].to_numpy(), right["fresh"].to_numpy(), left["via"].to_numpy(), right["at"].to_numpy()
        for one in np.unique(via):
            i, j = np.flatnonzero(via == one), np.flatnonzero(at == one)
            d = _between((a[0][i], a[1][i]), (b[0][j], b[1][j]), metric)
            row, col = np.nonzero((d <= worst[i][:, None] + TIE) & (new_a[i][:, None] | new_b[j][None]) & (ids[i][:, None] != names[j][None]))
            out.append(pd.DataFrame({"id": ids[i[row]], "nbr": names[j[col]], "dist": d[row, col]}))
        return pd.concat(out[1:]).drop_duplicates(["id", "nbr"])

    now, before = cut(knn(points, m, metric, method="annoy", seed=seed, aim=0.7)), None
    for _ in range(rounds):
        out = now.select("id", "nbr")
        back = Window.partitionBy("nbr").orderBy(F.xxhash64("id", "nbr"))
        both = out.union(out.withColumn("r", F.row_number().over(back)).where(F.col("r") <= m).select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()
        # pairs that only old links bring together were measured in an earlier round: they are in the lists or were beaten
        both = both.withColumn("new", F.lit(True)) if before is None else both.join(before.select("id", "nbr", F.lit(True).alias("old")), ["id", "nbr"], "left").select("id", "nbr", F.col("old").isNull().alias("new"))
        both = cut(both)
        worst = now.groupBy("id").agg(F.when(F.count("*") >= m, F.max("dist")).otherwise(float("inf")).alias("worst"))
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
        left = both.withColumnRenamed("nbr", "via").join(vec, "id").join(worst, "id", "left").select("id", "via", "new", "vec", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), bucket("via").alias("b"))
        right = both.select(F.col("id").alias("at"), "nbr", F.col("new").alias("fresh")).join(vec.select(F.col("id").alias("nbr"), F.col("vec").alias("other")), "nbr").select("at", "nbr", "fresh", "other", bucket("at").alias("c"))
        met = left.groupBy("b").cogroup(right.groupBy("c")).applyInPandas(meet, f"id {kind}, nbr {kind}, dist double")
        new = met.groupBy("id", "nbr").agg(F.min("dist").alias("dist")).join(now.select("id", "nbr"), ["id", "nbr"], "left_anti")
        better = best(now.drop("rank").select("id", "nbr", "dist").union(new))
        settled = better.select("id", "nbr").join(now.select("id", "nbr"), ["id", "nbr"], "left_anti").isEmpty()
        now, before = better, both
        if settled:
            break
    return now.where(F.col("rank") <= k).select("id", "rank", "nbr", "dist")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact (id, nbr) pairs that were found."""
    hit = found.select("id", "nbr", F.lit(1).alias("hit"))
    return exact.join(hit, ["id", "nbr"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def shared_neighbours(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, shared: neighbours common to two graphs."""
    both = a.select("id", "nbr").join(b.select("id", "nbr").distinct(), ["id", "nbr"]).groupBy("id").agg(F.count("*").alias("shared"))
    return a.select("id").distinct().join(both, "id", "left").select("id", F.coalesce("shared", F.lit(0)).alias("shared"))


def snn_graph(nn: DataFrame, k: int, method: str = "jaccard", pruning: float = 0.0, limited: bool = False) -> DataFrame:
    """src < dst, w: shared-neighbour weights, self counting at rank 0. limited: only for pairs of the neighbour graph.

    jaccard: s / (2 (k + 1) - s). rank: max(k - min((r_i + r_j) / 2), 1e-6) / k.
    """
    method = method.lower()
    if method not in ("jaccard", "rank"):
        raise ValueError("unknown method")
    every = nn.select("id", "nbr", "rank").union(nn.select("id").distinct().select("id", F.col("id").alias("nbr"), F.lit(0).alias("rank")))
    a, b = every.select(F.col("id").alias("src"), "nbr", F.col("rank").alias("ra")), every.select(F.col("id").alias("dst"), "nbr", F.col("rank").alias("rb"))
    s = a.join(b, "nbr").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("s"), F.min((F.col("ra") + F.col("rb")) / 2).alias("m"))
    w = F.col("s") / (2 * (k + 1) - F.col("s")) if method == "jaccard" else F.greatest(k - F.col("m"), F.lit(1e-6)) / k
    out = s.select("src", "dst", w.alias("w")).where(F.col("w") >= pruning)
    if limited:
        pairs = nn.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).distinct()
        out = out.join(pairs, ["src", "dst"], "left_semi")
    return out


def kbet(nn: DataFrame, batches: DataFrame) -> DataFrame:
    """id, chi2, p: neighbour batch counts against the global shares; two batches with Yates' correction. batches(id, batch)."""
    total = batches.count()
    share = batches.groupBy("batch").agg((F.count("*") / F.lit(float(total))).alias("share"))
    levels = share.count()
    size = nn.groupBy("id").agg(F.count("*").alias("k"))
    seen = nn.join(batches.select(F.col("id").alias("nbr"), "batch"), "nbr").groupBy("id", "batch").agg(F.count("*").alias("n"))
    grid = size.crossJoin(F.broadcast(share)).join(seen, ["id", "batch"], "left").na.fill(0, ["n"])
    expected = F.col("k") * F.col("share")
    gap = F.abs(F.col("n") - expected)
    gap = F.greatest(gap - 0.5, F.lit(0.0)) if levels == 2 else gap
    out = grid.groupBy("id").agg(F.sum(gap * gap / expected).alias("chi2"))
    return out.withColumn("p", chi2_sf_col(F.col("chi2"), F.lit(float(max(levels - 1, 1)))))


def lisi(nn: DataFrame, batches: DataFrame) -> DataFrame:
    """id, lisi: the inverse Simpson index of neighbour batches."""
    seen = nn.join(batches.select(F.col("id").alias("nbr"), "batch"), "nbr").groupBy("id", "batch").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("id"))
    return seen.withColumn("p", p).groupBy("id").agg((1 / F.sum(F.col("p") * F.col("p"))).alias("lisi"))


def silhouette(points: DataFrame, batches: DataFrame, metric: str = "euclidean", block: int = 2048, subsample: int | None = None, seed: int = 42) -> DataFrame:
    """id, silhouette by batch, of a seeded subsample if asked for. Distances are summed per point and batch within pairs of blocks; no pair is a row."""
    if subsample is not None:
        batches = batches.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(subsample)
    x = points.select("id", "vec").join(batches, "id")
    blocks = _blocks(x.count(), block)
    left = x.select("id", "vec", "batch").withColumn("a", F.expr(f"pmod(xxhash64(id), {blocks})")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = x.select("id", "vec", "batch").withColumn("b", F.expr(f"pmod(xxhash64(id), {blocks})")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = right.select(F.col("id").alias("rid"), F.col("vec").alias("rvec"), F.col("batch").alias("rbatch"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    ik, bk = (x.schema[c].dataType.simpleString() for c in ("id", "batch"))

    def sums(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        a, b = (_ready(np.array(x.tolist(), float), metric) for x in (p["vec"], q["rvec"]))
        parts, step, of = [], max(1, AT_ONCE // len(q)), q.reset_index(drop=True).groupby("rbatch").indices.items()
        for i in range(0, len(p), step):
            part = p.iloc[i : i + step]
            d = _between((a[0][i : i + step], a[1][i : i + step]), b, metric)
            d[part["id"].to_numpy()[:, None] == q["rid"].to_numpy()[None]] = 0
            parts += [pd.DataFrame({"id": part["id"], "own": part["batch"], "other": name, "s": d[:, at].sum(1)}) for name, at in of]
        return pd.concat(parts)

    s = left.groupBy("a", "b").cogroup(right.groupBy("ra", "rb")).applyInPandas(lambda p, q: sums(p, q) if len(p) and len(q) else pd.DataFrame(columns=["id", "own", "other", "s"]), f"id {ik}, own {bk}, other {bk}, s double")
    size = batches.groupBy(F.col("batch").alias("other")).agg(F.count("*").alias("n"))
    s = s.groupBy("id", "own", "other").agg(F.sum("s").alias("s")).join(size, "other")
    same = F.col("own") == F.col("other")
    m = s.groupBy("id").agg(F.max(F.when(same, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    return m.select("id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.median(value).alias("median"))


def cosine_normalised(points: DataFrame) -> DataFrame:
    return points.withColumn("vec", unit(F.col("vec")))


# ---- batch-balanced neighbours -------------------------------------------------------------------------------------


def balanced_knn(points: DataFrame, batches: DataFrame, k_within: int = 3, metric: str = "cosine") -> DataFrame:
    """id, rank, nbr, dist: k_within neighbours from each batch for every point, self left out."""
    out = None
    for b in [r.batch for r in batches.select("batch").distinct().orderBy("batch").collect()]:
        part = points.join(batches.where(F.col("batch") == b).select("id"), "id", "left_semi")
        one = knn(points, k_within + 1, metric, part).where("id != nbr")
        one = one.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where(F.col("rank") <= k_within)
        out = one if out is None else out.union(one)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr")))


def smooth_distances(nn: DataFrame, connectivity: float = 1.0, rounds: int = 64, tol: float = 1e-5, floor: float = 1e-3) -> DataFrame:
    """id, rho, sigma: distance of the nearest neighbours and the scale at which memberships sum to log2(k)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ident, dist, mean_all in zip(pdf["id"], pdf["d"], pdf["mean_all"], strict=True):
                d = np.sort(np.asarray(dist, float))
                some = d[d > 0]
                i = int(math.floor(connectivity))
                rho = 0.0
                if len(some) >= connectivity and i > 0:
                    rho = some[i - 1] + ((connectivity - i) * (some[i] - some[i - 1]) if connectivity - i > 1e-5 and i < len(some) else 0)
                elif len(some):
                    rho = some.max()
                lo, hi, s, goal = 0.0, np.inf, 1.0, math.log2(len(d) + 1)
                for _ in range(rounds):
                    gap = np.maximum(d - rho, 0)
                    total = np.where(gap > 0, np.exp(-gap / s), 1.0).sum()
                    if abs(total - goal) < tol:
                        break
                    if total > goal:
                        hi, s = s, (lo + s) / 2
                    else:
                        lo, s = s, s * 2 if np.isinf(hi) else (s + hi) / 2
                rows.append((ident, rho, max(s, floor * (d.mean() if rho > 0 else mean_all))))
            yield pd.DataFrame(rows, columns=["id", "rho", "sigma"])

    mean = nn.agg(F.avg("dist").alias("mean_all"))
    kind = nn.schema["id"].dataType.simpleString()
    return nn.groupBy("id").agg(F.collect_list("dist").alias("d")).crossJoin(F.broadcast(mean)).mapInPandas(run, f"id {kind}, rho double, sigma double")


def fuzzy_graph(nn: DataFrame, mix: float = 1.0, trim: int | None = None) -> DataFrame:
    """src, dst, w: memberships combined by fuzzy union and intersection, trimmed to each node's strongest edges."""
    scale = smooth_distances(nn)
    w = F.when(F.col("dist") <= F.col("rho"), 1.0).otherwise(F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma")))
    a = nn.join(scale, "id").select(F.col("id").alias("src"), F.col("nbr").alias("dst"), w.alias("w")).where("src != dst")
    both = a.union(a.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("s"), F.count("*").alias("n"), F.product("w").alias("p"))
    prod = F.when(F.col("n") == 2, F.col("p")).otherwise(0.0)
    out = both.select("src", "dst", (mix * (F.col("s") - prod) + (1 - mix) * prod).alias("w")).where("w > 0")
    if trim:
        cutoff = out.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w")))).where(F.col("r") == trim).select(F.col("src").alias("id"), F.col("w").alias("t"))
        ca, cb = cutoff.select(F.col("id").alias("src"), F.col("t").alias("ta")), cutoff.select(F.col("id").alias("dst"), F.col("t").alias("tb"))
        out = out.join(ca, "src", "left").join(cb, "dst", "left").where((F.col("w") >= F.coalesce("ta", F.lit(0.0))) & (F.col("w") >= F.coalesce("tb", F.lit(0.0)))).select("src", "dst", "w")
    return out


def bbknn(points: DataFrame, batches: DataFrame, k_within: int = 3, metric: str = "cosine", mix: float = 1.0, trim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distances and connectivities of the batch-balanced neighbour graph."""
    nn = cut(balanced_knn(points, batches, k_within, metric))
    return nn, fuzzy_graph(nn, mix, 10 * k_within if trim is None else trim)


# ---- mutual nearest neighbours -------------------------------------------------------------------------------------


def mutual_neighbours(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """left, right: pairs that are in each other's k nearest."""
    a = knn(left, k, metric, right).select(F.col("id").alias("left"), F.col("nbr").alias("right"))
    b = knn(right, k, metric, left).select(F.col("nbr").alias("left"), F.col("id").alias("right"))
    return a.join(b, ["left", "right"])


def merge_batches(left: DataFrame, right: DataFrame, k: int = 20, ndist: float = 3.0) -> DataFrame:
    """(id, vec) of both: right is moved by tricube-weighted means of its mutual pairs' differences.

    Both batches are centred along the mean batch vector first; without mutual pairs they are stacked as they are.
    """
    pairs = cut(mutual_neighbours(left, right, k))
    if pairs.isEmpty():
        return left.union(right)

    def shift() -> pd.DataFrame:
        v = pairs.join(left.select(F.col("id").alias("left"), F.col("vec").alias("a")), "left").join(right.select(F.col("id").alias("right"), F.col("vec").alias("b")), "right")
        return v.select("right", F.zip_with("a", "b", lambda x, y: x - y).alias("d"))

    parts = shift().select("right", F.posexplode("d").alias("i", "x"))
    batch = np.array(parts.groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").toPandas()["x"])  # one entry a dimension
    length = np.linalg.norm(batch)
    if length > 1e-10:
        axis = F.array(*[F.lit(float(x)) for x in batch / length])
        place = F.aggregate(F.zip_with("vec", axis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

        def centred(df: DataFrame) -> DataFrame:
            df = df.withColumn("p", place)
            mean = df.agg(F.avg("p").alias("m"))
            return cut(df.crossJoin(F.broadcast(mean)).select("id", F.zip_with("vec", axis, lambda x, y: x + (F.col("m") - F.col("p")) * y).alias("vec")))

        left, right = centred(left), centred(right)
    mean = shift().select("right", F.posexplode("d").alias("i", "x")).groupBy("right", "i").agg(F.avg("x").alias("x"))
    move = cut(mean.groupBy(F.col("right").alias("nbr")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("move")))
    anchors = right.join(move.select(F.col("nbr").alias("id")), "id", "left_semi")
    near = knn(right, k, "euclidean", anchors).join(move, "nbr")
    near = near.withColumn("h", ndist * F.median("dist").over(Window.partitionBy("id")))
    w = F.when(F.col("h") > 0, F.when(F.col("dist") < F.col("h"), F.pow(1 - F.pow(F.try_divide("dist", "h"), 3), 3)).otherwise(0.0)).otherwise((F.col("dist") == 0).cast("double"))
    x = near.withColumn("w", w).select("id", "w", F.posexplode("move").alias("i", "x")).groupBy("id", "i").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")), F.lit(0.0)).alias("x"))
    full = x.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("move"))
    return left.select("id", "vec").union(right.join(full, "id").select("id", F.zip_with("vec", "move", lambda a, b: a + b).alias("vec")))


def fast_mnn(points: DataFrame, batches: DataFrame, k: int = 20, ndist: float = 3.0, cosine: bool = True) -> DataFrame:
    """(id, vec) corrected: batches are merged one after the other in the order of their names."""
    x = cosine_normalised(points) if cosine else points
    out = None
    for b in [r.batch for r in batches.select("batch").distinct().orderBy("batch").collect()]:
        part = cut(x.select("id", "vec").join(batches.where(F.col("batch") == b).select("id"), "id", "left_semi"))
        out = part if out is None else cut(merge_batches(out, part, k, ndist))
    return out


# ---- soft-cluster correction ---------------------------------------------------------------------------------------


def harmony(points: DataFrame, batches: DataFrame, clusters: int = 10, sigma: float = 0.1, theta: float = 2.0, ridge: float = 1.0, rounds: int = 10, inner: int = 20, tol: float = 1e-4, seed: int = 42) -> DataFrame:
    """(id, vec) corrected by alternating soft clustering with a diversity penalty and ridge regression on the batch.

    Each inner round updates all points at once from the sums of the round before (clusters x batches), so a round is
    one pass; centroids and sums, of a size independent of the points, go through the driver.
    """
    levels = [r.batch for r in batches.select("batch").distinct().orderBy("batch").collect()]
    code = {b: i for i, b in enumerate(levels)}
    data = points.select("id", "vec").join(batches, "id").select("id", "vec", F.col("vec").alias("orig"), "batch")
    data = cut(data)
    dim, n_levels = len(data.select("vec").first().vec), len(levels)
    n_by = np.zeros(n_levels)
    for r in data.groupBy("batch").agg(F.count("*").alias("n")).collect():
        n_by[code[r.batch]] = r.n
    share = n_by / n_by.sum()
    sample = np.array([r.vec for r in data.orderBy(F.xxhash64("id", F.lit(seed))).limit(max(50 * clusters, 500)).select("vec").collect()])
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-10)
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), clusters, replace=len(sample) < clusters)]
    for _ in range(inner):
        label = (sample @ centre.T).argmax(1)
        centre = np.array([sample[label == c].mean(0) if (label == c).any() else centre[c] for c in range(clusters)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-10)
    observed = None

    def soft(vec: np.ndarray, batch: np.ndarray, centre: np.ndarray, observed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        z = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-10)
        d = 2 * (1 - z @ centre.T)
        r = np.exp(-(d - d.min(1, keepdims=True)) / sigma)
        if observed is not None:
            expected = observed.sum(1, keepdims=True) * share[None]
            r = r * (((expected + 1e-10) / (observed + expected + 1e-10)) ** theta)[:, batch].T
        return z, r / np.maximum(r.sum(1, keepdims=True), 1e-300)

    def total(df: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = np.zeros(shape)
            for pdf in it:
                if len(pdf):
                    s += part(np.array(pdf["vec"].tolist()), np.array(pdf["orig"].tolist()), pdf["batch"].map(code).to_numpy())
            yield pd.DataFrame({"i": np.arange(s.size), "x": s.ravel()})

        out = np.zeros(int(np.prod(shape)))
        for r in df.mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r.i] = r.x
        return out.reshape(shape)

    last = None
    for _ in range(rounds):
        for _ in range(3):

            def sums(vec, orig, batch, centre=centre, observed=observed):
                z, r = soft(vec, batch, centre, observed)
                o = np.stack([r[batch == b].sum(0) for b in range(n_levels)], 1)
                return np.hstack([r.T @ z, o])

            s = total(data, sums, (clusters, dim + n_levels))
            centre = s[:, :dim] / np.maximum(np.linalg.norm(s[:, :dim], axis=1, keepdims=True), 1e-10)
            observed = s[:, dim:]

        def products(vec, orig, batch, centre=centre, observed=observed):
            _, r = soft(vec, batch, centre, observed)
            return np.stack([r[batch == b].T @ orig[batch == b] for b in range(n_levels)], 1)

        moments = total(data, products, (clusters, n_levels, dim))
        # per cluster: intercept and one-hot batches, the intercept is not penalised and not subtracted
        effect = np.zeros((clusters, n_levels, dim))
        for c in range(clusters):
            a = np.zeros((n_levels + 1, n_levels + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = observed[c].sum(), observed[c], observed[c]
            a[1:, 1:] = np.diag(observed[c] + ridge)
            a[0, 0] += 1e-10
            effect[c] = np.linalg.solve(a, np.vstack([moments[c].sum(0), moments[c]]))[1:]

        def correct(it: Iterator[pd.DataFrame], centre=centre, observed=observed, effect=effect) -> Iterator[pd.DataFrame]:
            for pdf in it:
                if len(pdf):
                    batch = pdf["batch"].map(code).to_numpy()
                    _, r = soft(np.array(pdf["vec"].tolist()), batch, centre, observed)
                    orig = np.array(pdf["orig"].tolist())
                    yield pdf.assign(vec=list(orig - np.einsum("nc,ncd->nd", r, effect[:, batch].transpose(1, 0, 2))))

        data = cut(data.mapInPandas(correct, data.schema))
        size = float(np.linalg.norm(effect))
        if last is not None and abs(size - last) <= tol * max(last, 1e-10):
            break
        last = size
    return data.select("id", "vec")


# ---- neighbourhood sampling ----------------------------------------------------------------------------------------


def sample_neighbourhoods(points: DataFrame, nn: DataFrame, share: float = 0.2, seed: int = 42, metric: str = "euclidean", strategy: str = "approximate", index: str | None = None) -> DataFrame:
    """index: cells nearest to the median position of a sampled cell's neighbours.

    approximate looks among those only, bruteforce among all cells, index into a saved index (made here unless its folder is given).
    """
    strategy = strategy.lower()
    if strategy not in ("approximate", "bruteforce", "index"):
        raise ValueError("unknown strategy")
    picked = nn.select("id").distinct().where(F.expr(f"pmod(xxhash64(id, {seed}), 1000000) < {int(share * 1e6)}"))
    near = nn.join(picked, "id").select("id", "nbr")
    at = near.join(points.select(F.col("id").alias("nbr"), "vec"), "nbr").select("id", F.posexplode("vec").alias("i", "x"))
    median = at.groupBy("id", "i").agg(F.median("x").alias("x")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    if strategy == "approximate":
        cand = near.join(median, "id").join(points.select(F.col("id").alias("nbr"), F.col("vec").alias("v")), "nbr")
        d = F.aggregate(F.zip_with("vec", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return cand.groupBy("id").agg(F.min_by("nbr", F.struct(d, "nbr")).alias("index")).select("index").distinct()
    if strategy == "index":
        if index is None:
            index = scratch(points.sparkSession, "index")
            save_index(points, index, metric, seed=seed)
        return search_index(points.sparkSession, index, median, 1).select(F.col("nbr").alias("index")).distinct()
    return knn(median, 1, metric, points).select(F.col("nbr").alias("index")).distinct()


def neighbourhood_matrix(nn: DataFrame, index: DataFrame) -> DataFrame:
    """row (cell), col (index cell), value 1: an index cell and its neighbours."""
    own = index.select(F.col("index").alias("row"), F.col("index").alias("col"))
    near = nn.join(index, nn.id == F.col("index")).select(F.col("nbr").alias("row"), F.col("id").alias("col"))
    return own.union(near).distinct().withColumn("value", F.lit(1.0))


def kth_distance(nn: DataFrame, index: DataFrame, k: int) -> DataFrame:
    return nn.where(F.col("rank") == k).join(index, F.col("id") == F.col("index")).select("index", "dist")


def neighbour_lists(nn: DataFrame, self_first: bool = False) -> DataFrame:
    lists = nn.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda s: s["nbr"]).alias("nn"))
    return lists.withColumn("nn", F.concat(F.array("id"), "nn")) if self_first else lists


def vectors_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("id", F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))
