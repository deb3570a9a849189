"""Regulatory networks: tree-ensemble importances of regulators for every target gene.

Regulators are quantised to 256 bins and stay a sparse table; target genes are dealt to batches that share their trees, and
all trees grow level by level (``operators.trees``). Boosting has a tree a gene at a time, all genes side by side: by levels
too, or, where the bins of all cells fit into a task, gene by gene in tasks.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from helixframe.operators import trees as T
from helixframe.operators.decomposition import sparse_svd
from helixframe.operators.graph import farthest_first_kmeans
from helixframe.plans.checkpoint import cut

LEARNERS = {"extratrees": "extratrees", "rf": "rf", "randomforest": "rf", "boosted": "boosted", "grnboost2": "boosted", "lightgbm": "boosted"}
#: Boosting looks at all features from that many cells on, at a root of their number below.
FULL_CELLS = 10_000
#: Bytes that the bins above 0 and the cells may take in a task.
MAX_BYTES = 512 << 20


def batches_of_genes(norm: DataFrame, n_cells: int, size: int = 64, strategy: str = "random", components: int = 50, seed: int = 42) -> DataFrame:
    """gene, batch: in a seeded order, or by k-means on gene loadings so that a batch holds similar genes."""
    strategy = strategy.lower()
    genes = norm.select("gene").distinct()
    if strategy == "random":
        from pyspark.sql import Window

        order = F.row_number().over(Window.orderBy(F.xxhash64("gene", F.lit(seed)), "gene")) - 1
        return genes.select("gene", F.floor(order / size).cast("int").alias("batch"))
    if strategy != "correlated":
        raise ValueError("unknown strategy")
    _, v, names = sparse_svd(norm, n_cells, components)
    k = max(1, len(names) // size)
    label = farthest_first_kmeans(v, k, 25, seed)
    order = np.lexsort((np.random.default_rng(seed).permutation(len(names)), label))
    return norm.sparkSession.createDataFrame([(names[g], i // size) for i, g in enumerate(order.tolist())], "gene long, batch int")


def subsampled(cells: DataFrame, most: int | None, seed: int = 42) -> DataFrame:
    """Those ``most`` cells of the smallest hash."""
    own = cells.select("cell").distinct()
    return own if most is None else own.orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(most)


def forest(bins: DataFrame, y: DataFrame, cells: DataFrame, features: list[int], trees: int = 250, depth: int = 10, leaf: int = 50, looks: int = 0, subsample: float = 0.632, bootstrap: bool = False, thresholds: int | None = None, min_variance: float = 1e-10, seed: int = 42, together: int = 50, banned: DataFrame | None = None) -> DataFrame:
    """(target, tf, importance), importances of a target summing to 1, of ``trees`` trees for each batch of y, ``together`` at a time."""
    out, batches = None, cut(y.select("batch").distinct())
    for at in range(0, trees, together):
        state = T.planted(cells, batches, range(at, min(at + together, trees)), subsample, bootstrap, seed)
        gains = T.grow(cut(state), bins, y, features, depth, leaf, looks, min_variance, thresholds, seed, banned).gains
        if gains is not None:
            one = cut(gains.groupBy("target", "tf").agg(F.sum("gain").alias("gain")))
            out = one if out is None else out.unionByName(one)
    return shares(out, y.sparkSession)


def boosting_by_levels(bins: DataFrame, y: DataFrame, cells: DataFrame, features: list[int], trees: int = 1000, depth: int = 3, leaf: int = 50, looks: int = 0, subsample: float = 0.9, rate: float = 0.01, window: int = 25, seed: int = 42, banned: DataFrame | None = None) -> DataFrame:
    """(target, tf, importance) of boosted trees, a batch of y for each target.

    Every tree is fitted to what the ones before left over, on a share of the cells; a target stops when the mean gain on
    the other cells of the last ``window`` trees is 0 or less.
    """
    spark = y.sparkSession
    targets = y.select("batch", "target").distinct()
    left = cells.select("cell").join(F.broadcast(targets)).join(y, ["batch", "target", "cell"], "left").select("batch", "cell", "target", F.coalesce("v", F.lit(0.0)).alias("v"))
    left, out = cut(left), None
    recent: dict[int, deque] = defaultdict(lambda: deque(maxlen=window))
    for tree in range(trees):
        u = T.uniform(F.lit(seed), "batch", F.lit(tree), "cell")
        state = left.select("batch", F.lit(tree).alias("tree"), "cell", (u < subsample).cast("int").alias("w"), F.lit(1).cast("long").alias("node"))
        grown = T.grow(state, bins, left, features, depth, leaf, looks, 0.0, None, seed + tree, banned)
        if grown.gains is not None:
            out = grown.gains.select("target", "tf", "gain") if out is None else out.unionByName(grown.gains.select("target", "tf", "gain"))
        leaves = grown.sums.join(grown.sizes, T.NODE).select("batch", "node", "target", (rate * F.col("s") / F.col("n")).alias("p"))
        step = grown.state.join(left, ["batch", "cell"]).join(leaves, ["batch", "node", "target"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
        step = cut(step.select("batch", "cell", "target", "w", (F.col("v") - F.col("p")).alias("v"), (2 * F.col("p") * F.col("v") - F.col("p") * F.col("p")).alias("gain")))
        done = []
        for r in step.groupBy("batch").agg(F.avg(F.when(F.col("w") == 0, F.col("gain"))).alias("gain")).collect():  # a row a target
            recent[r.batch].append(1.0 if r.gain is None else r.gain)
            if len(recent[r.batch]) == window and sum(recent[r.batch]) <= 0:
                done.append(r.batch)
        left = step.select("batch", "cell", "target", "v")
        if done:
            left = cut(left.join(F.broadcast(spark.createDataFrame([(b,) for b in done], "batch int")), "batch", "left_anti"))
            if left.isEmpty():
                break
        if out is not None and tree % 10 == 9:
            out = cut(out.groupBy("target", "tf").agg(F.sum("gain").alias("gain")))
    return shares(out, spark)


class Bins:
    """Bins above 0 of cells and features, by feature and cell: what dense bins hold, without their zeros."""

    def __init__(self, cell: np.ndarray, feature: np.ndarray, value: np.ndarray, cells: int, features: int):
        order = np.lexsort((cell, feature))
        self.cell, self.feature, self.value = (np.asarray(x)[order].astype(t) for x, t in ((cell, np.int32), (feature, np.int32), (value, np.uint8)))
        self.start, self.shape = np.searchsorted(self.feature, np.arange(features + 1)), (cells, features)

    @classmethod
    def of(cls, q: np.ndarray) -> Bins:
        cell, feature = np.nonzero(q)
        return cls(cell, feature, q[cell, feature], *q.shape)

    def part(self, f: int) -> slice:
        return slice(self.start[f], self.start[f + 1])

    def column(self, f: int) -> np.ndarray:
        out = np.zeros(self.shape[0], np.uint8)
        out[self.cell[self.part(f)]] = self.value[self.part(f)]
        return out


def _split(q: Bins, own: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int) -> tuple[float, int, int]:
    """Best (n * reduction, feature, bin) of the rows ``own`` of values y of all cells: right from that bin on."""
    n, total, inside = len(own), y[own].sum(), np.zeros(len(y), bool)
    inside[own] = True
    best = (1e-9, -1, 0)
    for at in range(0, len(features), 4096):
        some = features[at : at + 4096]
        size = q.start[some + 1] - q.start[some]
        entry = np.repeat(q.start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.repeat(np.arange(len(some)), size)
        held = inside[q.cell[entry]]
        entry, key = entry[held], place[held] * 256 + q.value[entry[held]]
        upto = lambda x, k=len(some): np.cumsum(x.reshape(k, 256)[:, ::-1], axis=1)[:, ::-1][:, 1:]
        m = upto(np.bincount(key, minlength=256 * len(some)))
        r = upto(np.bincount(key, y[q.cell[entry]], 256 * len(some)))
        row, col = np.nonzero((m >= leaf) & (n - m >= leaf))
        if len(row):
            m, r = m[row, col], r[row, col]
            gain = r**2 / m + (total - r) ** 2 / (n - m) - total * total / n
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(some[row[i]]), int(col[i]) + 1)
    return best


def boosting(q: Bins | np.ndarray, y: np.ndarray, trees: int, depth: int = 3, leaf: int = 50, looks: int = 0, subsample: float = 0.9, rate: float = 0.01, window: int = 25, seed: int = 42) -> np.ndarray:
    """The importances of boosting one target on bins (cells x features); as boosting_by_levels, with other draws."""
    q = Bins.of(q) if isinstance(q, np.ndarray) else q
    left, total, gains, n = y.astype(float).copy(), np.zeros(q.shape[1]), deque(maxlen=window), len(y)
    k = looks or max(1, int(np.sqrt(q.shape[1])))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        trained = rng.random(n) < subsample
        step, root = np.zeros(n), max(1, int(trained.sum()))
        nodes = [(np.arange(n), 0)]
        while nodes:
            rows, level = nodes.pop()
            own = rows[trained[rows]]
            if len(own) >= 2 * leaf and level < depth:
                gain, f, b = _split(q, own, left, rng.permutation(q.shape[1])[:k], leaf)
                if f >= 0:
                    total[f] += gain / root
                    right = q.column(f)[rows] >= b
                    nodes += [(rows[~right], level + 1), (rows[right], level + 1)]
                    continue
            step[rows] = rate * left[own].mean() if len(own) else 0.0
        out = ~trained
        gains.append(float((2 * step[out] * left[out] - step[out] ** 2).mean()) if out.any() else 1.0)
        left -= step
        if len(gains) == window and sum(gains) <= 0:
            break
    return total / total.sum() if total.sum() > 0 else total


def boosting_in_tasks(bins: DataFrame, y: DataFrame, cells: DataFrame, features: list[int], block: int = 64, exclude_self: bool = False, **how) -> DataFrame:
    """boosting of each target of y(batch, cell, target, v) on its own: bins are sent once to each block of targets."""
    if 9 * bins.count() + 8 * cells.count() > MAX_BYTES:
        raise ValueError("the bins do not fit into a task: grow by levels, or take fewer cells")
    blocks = y.select("target").distinct().withColumn("block", F.expr(f"pmod(xxhash64(target), greatest(1, int(ceil(count(*) over () / {float(block)}))))"))
    sent = bins.join(F.broadcast(blocks.select("block").distinct()))
    every = cells.select(F.col("cell"), F.lit(-1).cast("long").alias("tf"), F.lit(0).alias("bin")).join(F.broadcast(blocks.select("block").distinct()))
    own = y.join(blocks, "target").select(F.col("block").alias("to"), F.col("cell").alias("at"), "target", "v")  # own names: both sides come from y
    column = {f: i for i, f in enumerate(features)}

    def fit(bins: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(bins.loc[bins["tf"] == -1, "cell"].to_numpy())
        bins = bins[bins["tf"] != -1]
        cell, feature = np.searchsorted(names, bins["cell"]), bins["tf"].map(column).to_numpy(int)
        out = []
        for target, rows in values.groupby("target"):
            left = np.zeros(len(names))
            left[np.searchsorted(names, rows["at"])] = rows["v"]
            use = np.array([i for f, i in column.items() if not (exclude_self and f == target)], int)
            kept = np.isin(feature, use)
            q = Bins(cell[kept], np.searchsorted(use, feature[kept]), bins["bin"].to_numpy()[kept], len(names), len(use))
            found = boosting(q, left, seed=abs(int(target)), **how) if len(use) else np.zeros(0)
            out.append(pd.DataFrame({"target": target, "tf": np.array(features)[use], "importance": found}))
        return pd.concat(out) if out else pd.DataFrame(columns=["target", "tf", "importance"])

    both = sent.select("block", "cell", "tf", "bin").unionByName(every.select("block", "cell", "tf", "bin"))
    return both.groupBy("block").cogroup(own.groupBy("to")).applyInPandas(fit, "target long, tf long, importance double")


def shares(gains: DataFrame | None, spark) -> DataFrame:
    """Gains (target, tf, gain) as shares of each target's."""
    if gains is None:
        return spark.createDataFrame([], "target long, tf long, importance double")
    total = gains.groupBy("target").agg(F.sum("gain").alias("all"))
    own = gains.groupBy("target", "tf").agg(F.sum("gain").alias("gain"))
    return own.join(total, "target").where("all > 0").select("target", "tf", (F.col("gain") / F.col("all")).alias("importance"))


def regulatory_network(norm: DataFrame, cells: DataFrame, regulators: DataFrame, targets: DataFrame, learner: str = "rf", trees: int = 250, depth: int = 10, leaf: int = 50, features: int = 0, subsample: float = 0.632, bootstrap: bool = False, rate: float = 0.01, window: int = 25, thresholds: int = 1, min_variance: float = 1e-10, exclude_self: bool = False, seed: int = 42, batch: int = 64, strategy: str = "random", most_cells: int | None = None, by_levels: bool = True) -> DataFrame:
    """gene, tf, importance (sums to 1 per gene, 0 where nothing was gained).

    Targets share trees in batches of ``batch``; with boosting or exclude_self each is a batch of its own. A target that is a
    regulator itself keeps itself unless exclude_self. by_levels: whether boosting grows over tables or gene by gene in tasks.
    """
    learner = LEARNERS.get(learner.lower())
    if learner is None:
        raise ValueError("unknown learner")
    tfs = [r.gene for r in regulators.select("gene").distinct().orderBy("gene").collect()]
    own = cut(subsampled(cells, most_cells, seed))
    n = own.count()
    wanted = cut(norm.join(targets.select("gene").distinct(), "gene", "left_semi").join(own, "cell", "left_semi"))
    alone = exclude_self or learner == "boosted"
    dealt = cut(batches_of_genes(wanted, n, 1 if alone else batch, "random" if alone else strategy, seed=seed))
    genes = dealt.select("gene").crossJoin(regulators.select(F.col("gene").alias("tf")).distinct())
    if not tfs:
        return genes.withColumn("importance", F.lit(0.0))
    y = cut(wanted.join(dealt, "gene").select("batch", "cell", F.col("gene").alias("target"), F.col("norm").cast("double").alias("v")))
    bins = cut(T.quantised(norm, regulators, own))
    banned = dealt.select("batch", F.col("gene").alias("tf")) if exclude_self else None
    looks = features or (len(tfs) if n >= FULL_CELLS else 0)
    if learner == "boosted" and not by_levels:
        found = boosting_in_tasks(bins, y, own, tfs, exclude_self=exclude_self, trees=trees, depth=depth, leaf=leaf, looks=looks, subsample=subsample, rate=rate, window=window)
    elif learner == "boosted":
        found = boosting_by_levels(bins, y, own, tfs, trees, depth, leaf, looks, subsample, rate, window, seed, banned)
    else:
        found = forest(bins, y, own, tfs, trees, depth, leaf, features, subsample, bootstrap, thresholds if learner == "extratrees" else None, min_variance, seed, banned=banned)
    found = found.withColumnRenamed("target", "gene")
    return genes.join(found, ["gene", "tf"], "left").select("gene", "tf", F.coalesce("importance", F.lit(0.0)).alias("importance"))
