"""Regression trees grown level by level over tables: all trees of all target batches at once, no matrix anywhere.

Features are (cell, tf, bin) with bins 1..255; a cell without a row is in bin 0. Targets are (batch, cell, target, v), zeros
left out. State is (batch, tree, cell, w, node): how often a cell counts in a tree, and the node it lies in (root 1, children
2i and 2i + 1). A level is one histogram: state joined with features and targets, summed by node, feature and bin before
it is shuffled. Bin 0 is never a row: what is right of a split is summed from the top bin down, and left is the node less that.

For a node of n cells with target sums s_t, sending bins >= b (n_R cells, sums r_t) to the right gains

    n * reduction = A / n_R + (S - 2 C + A) / (n - n_R) - S / n,   S = sum s_t^2, C = sum s_t r_t, A = sum r_t^2,

and A and C change from bin to bin only by the targets that the bin holds, so running sums over rows that exist are enough.
Where a tree looks at all features, only the smaller child of a split is counted and its sibling is the parent's histogram
less it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from helixframe.plans.checkpoint import cut

NODE = ["batch", "tree", "node"]


@dataclass
class Tree:
    """Of all trees: splits (node, tf, bin, gain, n, n_right), gains (node, target, tf, gain), final state, node sizes and sums."""

    splits: DataFrame
    gains: DataFrame
    state: DataFrame
    sizes: DataFrame
    sums: DataFrame


def quantised(norm: DataFrame, features: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, tf, bin): values of the features scaled to 0..255 between their least and largest, zeros among them; bins of 0 are left out."""
    n = cells.count()
    x = norm.join(features.select("gene").distinct(), "gene", "left_semi").join(cells.select("cell"), "cell", "left_semi")
    ends = x.groupBy("gene").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.count("*").alias("n"))
    # implicit zeros count as values
    zero = F.when(F.col("n") < n, F.lit(0.0))
    ends = ends.select("gene", F.least("lo", F.coalesce(zero, "lo")).alias("lo"), F.greatest("hi", F.coalesce(zero, "hi")).alias("hi"))
    bins = x.join(ends, "gene").where("hi > lo").select("cell", F.col("gene").alias("tf"), F.round((F.col("norm") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))).cast("int").alias("bin"))
    return bins.where("bin > 0")


def uniform(*by) -> F.Column:
    """A number in [0, 1) that hashes its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*by), 11) / F.lit(float(1 << 53))


def planted(cells: DataFrame, batches: DataFrame, trees: Sequence[int], share: float, replace: bool, seed: int) -> DataFrame:
    """State of roots: each cell is in a tree with probability share or, with replacement, a Poisson number of times of that mean."""
    every = cells.select("cell").join(F.broadcast(batches.select("batch").distinct()).withColumn("tree", F.explode(F.lit(list(trees)))))
    if share >= 1:
        return every.select("batch", "tree", "cell", F.lit(1).alias("w"), F.lit(1).cast("long").alias("node"))
    u = uniform(F.lit(seed), "batch", "tree", "cell")
    if not replace:
        w = (u < share).cast("int")
    else:
        upto, at, w = np.exp(-share), np.exp(-share), F.lit(0)
        for i in range(1, 30):
            w = w + (u >= float(upto)).cast("int")
            at *= share / i
            upto += at
    return every.select("batch", "tree", "cell", w.alias("w"), F.lit(1).cast("long").alias("node"))


def chosen(seed: int, batch: int, tree: int, node: int, features: np.ndarray, k: int) -> np.ndarray:
    """The k features that a node looks at."""
    return features[np.random.default_rng([seed, batch, tree, node]).permutation(len(features))[:k]]


def _looks(nodes: DataFrame, features: Sequence[int], k: int, seed: int) -> DataFrame:
    own = np.array(features, np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["tf"] = [chosen(seed, b, t, i, own, k) for b, t, i in zip(pdf["batch"], pdf["tree"], pdf["node"], strict=True)]
            yield pdf

    return nodes.select(*NODE).mapInPandas(run, "batch int, tree int, node long, tf array<long>").withColumn("tf", F.explode("tf"))


def histogram(state: DataFrame, bins: DataFrame, y: DataFrame, looks: DataFrame | None = None, banned: DataFrame | None = None) -> DataFrame:
    """(batch, tree, node, tf, bin, target, n, s, ss): cells where target is null, weighted sums and squares of each target otherwise.

    looks(batch, tree, node, tf): the features that each node looks at, all without it.
    """
    base = state.join(bins, "cell")
    if looks is not None:
        base = base.join(looks, [*NODE, "tf"], "left_semi")
    if banned is not None:
        base = base.join(banned, ["batch", "tf"], "left_anti")
    cell = base.groupBy(*NODE, "tf", "bin").agg(F.sum("w").cast("long").alias("n"))
    v = F.col("w") * F.col("v")
    sums = base.join(y, ["batch", "cell"]).groupBy(*NODE, "tf", "bin", "target").agg(F.sum(v).alias("s"), F.sum(v * F.col("v")).alias("ss"))
    none = F.lit(None)
    return cell.select(*NODE, "tf", "bin", none.cast("long").alias("target"), "n", none.cast("double").alias("s"), none.cast("double").alias("ss")).unionByName(sums.withColumn("n", none.cast("long")))


def subtracted(parent: DataFrame, child: DataFrame, siblings: DataFrame) -> DataFrame:
    """Histograms of siblings(batch, tree, node, small, parent): the parent's less the small child's."""
    other = siblings.select("batch", "tree", F.col("node").alias("to"), "small", "parent")
    values = ["n", "s", "ss"]
    plus = parent.join(other.withColumn("node", F.col("parent")), NODE)
    minus = child.join(other.withColumn("node", F.col("small")), NODE).withColumns({c: -F.col(c) for c in values})
    both = plus.unionByName(minus).groupBy("batch", "tree", F.col("to").alias("node"), "tf", "bin", "target")
    out = both.agg(*[F.sum(c).alias(c) for c in values])
    return out.where("target is not null or n > 0").select(*parent.columns)


def best_splits(hist: DataFrame, sizes: DataFrame, sums: DataFrame, leaf: int, thresholds: int | None = None, seed: int = 0) -> DataFrame:
    """(batch, tree, node, tf, bin, gain, n, n_right): of all splits the one of the largest gain, n * reduction; ties to the smaller tf and bin.

    thresholds: only that many random bins of each feature's range are tried.
    """
    by = [*NODE, "tf"]
    own = sums.select(*NODE, "target", F.col("s").alias("total"))
    down = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    of = hist.where("target is not null").withColumn("upto", F.sum("s").over(down(*by, "target")))
    of = of.join(own, [*NODE, "target"], "left").select(*by, "bin", F.lit(0).cast("long").alias("n"), (F.col("upto") * F.col("upto") - F.pow(F.col("upto") - F.col("s"), 2)).alias("a"), (F.col("s") * F.coalesce("total", F.lit(0.0))).alias("c"))
    cells = hist.where("target is null").select(*by, "bin", "n", F.lit(0.0).alias("a"), F.lit(0.0).alias("c"))
    steps = cells.unionByName(of).groupBy(*by, "bin").agg(*[F.sum(x).alias(x) for x in ("n", "a", "c")])
    upto = steps.select(*by, "bin", *[F.sum(x).over(down(*by)).alias(x) for x in ("n", "a", "c")], F.coalesce(F.lag("bin").over(Window.partitionBy(*by).orderBy("bin")), F.lit(0)).alias("below"), F.max("bin").over(Window.partitionBy(*by)).alias("top"), F.min("bin").over(Window.partitionBy(*by)).alias("low"), F.sum("n").over(Window.partitionBy(*by)).alias("some"))
    square = sums.groupBy(*NODE).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    tried = upto.join(sizes.select(*NODE, F.col("n").alias("all")), NODE).join(square, NODE)
    left = F.col("all") - F.col("n")
    tried = tried.where((F.col("n") >= leaf) & (left >= leaf))
    if thresholds is not None:
        bottom = F.when(F.col("some") < F.col("all"), 0).otherwise(F.col("low"))
        draws = [bottom + F.pmod(F.xxhash64(F.lit(seed + i), *by), F.greatest(F.col("top") - bottom, F.lit(1))) for i in range(thresholds)]
        hit = F.lit(False)
        for d in draws:
            hit = hit | ((d >= F.col("below")) & (d < F.col("bin")))
        tried = tried.where(hit)
    gain = F.col("a") / F.col("n") + (F.col("square") - 2 * F.col("c") + F.col("a")) / left - F.col("square") / F.col("all")
    tried = tried.withColumn("gain", gain)
    # of each feature first, along its bins' order; then of the features: no task sorts all splits of a node
    each = tried.groupBy(*by).agg(F.max(F.struct(F.round("gain", 9).alias("g"), (-F.col("bin")).alias("b"), "gain", "all", "n")).alias("x"))
    best = each.groupBy(*NODE).agg(F.max(F.struct(F.col("x.g").alias("g"), (-F.col("tf")).alias("t"), "x")).alias("y"))
    best = best.select(*NODE, (-F.col("y.t")).alias("tf"), (-F.col("y.x.b")).alias("bin"), F.col("y.x.gain").alias("gain"), F.col("y.x.all").alias("n"), F.col("y.x.n").alias("n_right"))
    return best.where("gain > 1e-9")


def grow(state: DataFrame, bins: DataFrame, y: DataFrame, features: Sequence[int], depth: int, leaf: int, looks: int = 0, min_variance: float = 1e-10, thresholds: int | None = None, seed: int = 42, banned: DataFrame | None = None) -> Tree:
    """All trees of a state of roots. looks: features that a node looks at, drawn anew for each; 0 for the root of their number.

    banned(batch, tf): features that no tree of a batch may use.
    """
    k = min(looks or max(1, int(len(features) ** 0.5)), len(features))
    counted = state.where("w > 0")
    v = F.col("w") * F.col("v")
    sizes = cut(counted.groupBy(*NODE).agg(F.sum("w").cast("long").alias("n")))
    sums = cut(counted.join(y, ["batch", "cell"]).groupBy(*NODE, "target").agg(F.sum(v).alias("s"), F.sum(v * F.col("v")).alias("ss")))
    roots = sizes.select("batch", "tree", F.col("n").alias("n_root"))
    now_sizes, now_sums, all_sizes, all_sums, splits, gains = sizes, sums, sizes, sums, None, None
    hist = siblings = None
    for level in range(depth):
        spread = F.sum(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)))
        alive = now_sizes.where(F.col("n") >= 2 * leaf).join(now_sums, NODE).groupBy(*NODE).agg(spread.alias("var")).where(F.col("var") >= min_variance).select(*NODE)
        if k < len(features):
            alive = cut(alive)
            hist = cut(histogram(state.where("w > 0").join(alive, NODE, "left_semi"), bins, y, _looks(alive, features, k, seed), banned))
        elif siblings is None:
            hist = cut(histogram(state.where("w > 0").join(alive, NODE, "left_semi"), bins, y, banned=banned))
        else:
            small = siblings.select("batch", "tree", F.col("small").alias("node"))
            counted_now = cut(histogram(state.where("w > 0").join(small, NODE, "left_semi"), bins, y, banned=banned))
            hist = cut(counted_now.unionByName(subtracted(hist, counted_now, siblings)).join(alive, NODE, "left_semi"))
        best = cut(best_splits(hist, now_sizes, now_sums, leaf, thresholds, seed))
        if best.isEmpty():
            break
        right = hist.where("target is not null").join(best.select(*NODE, "tf", F.col("bin").alias("from")), [*NODE, "tf"]).where(F.col("bin") >= F.col("from")).groupBy(*NODE, "target").agg(F.sum("s").alias("r"), F.sum("ss").alias("rr"))
        halves = cut(now_sums.join(best.select(*NODE, "tf", "n", "n_right"), NODE).join(right, [*NODE, "target"], "left").na.fill(0.0, ["r", "rr"]))
        reduction = F.col("r") * F.col("r") / F.col("n_right") + F.pow(F.col("s") - F.col("r"), 2) / (F.col("n") - F.col("n_right")) - F.col("s") * F.col("s") / F.col("n")
        gained = halves.join(roots, ["batch", "tree"]).select(*NODE, "target", "tf", (F.greatest(F.lit(0.0), reduction) / F.col("n_root")).alias("gain"))
        splits = best if splits is None else splits.unionByName(best)
        gains = gained if gains is None else gains.unionByName(gained)
        child = lambda side: (F.col("node") * 2 + side).alias("node")
        now_sizes = best.select("batch", "tree", child(0), (F.col("n") - F.col("n_right")).alias("n")).unionByName(best.select("batch", "tree", child(1), F.col("n_right").alias("n")))
        now_sums = halves.select("batch", "tree", child(0), "target", (F.col("s") - F.col("r")).alias("s"), (F.col("ss") - F.col("rr")).alias("ss")).unionByName(halves.select("batch", "tree", child(1), "target", F.col("r").alias("s"), F.col("rr").alias("ss")))
        less = (F.col("n_right") * 2 <= F.col("n")).cast("int")
        siblings = best.select("batch", "tree", (F.col("node") * 2 + 1 - less).alias("node"), (F.col("node") * 2 + less).alias("small"), F.col("node").alias("parent"))
        all_sizes, all_sums = all_sizes.unionByName(now_sizes), all_sums.unionByName(now_sums)
        at = state.join(best.select(*NODE, "tf", F.col("bin").alias("from")), NODE, "left").join(bins, ["cell", "tf"], "left")
        moved = F.when(F.col("tf").isNull(), F.col("node")).otherwise(2 * F.col("node") + (F.coalesce("bin", F.lit(0)) >= F.col("from")).cast("int"))
        state = at.select("batch", "tree", "cell", "w", moved.alias("node"))
        if level % 3 == 2:
            state = cut(state)
    return Tree(splits, gains, state, all_sizes, all_sums)
