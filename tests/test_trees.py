"""Level-wise trees against plain ones grown node by node on dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import regulation as R, trees as T


def split(q, y, rows, tfs, leaf):
    """Best (gain, tf, bin) over all features and thresholds: right if q >= bin."""
    best = (1e-9, None, None)
    s, n = y[rows].sum(0), len(rows)
    for f in tfs:
        for b in np.unique(q[rows, f])[1:]:
            right = q[rows, f] >= b
            m = right.sum()
            if m < leaf or n - m < leaf:
                continue
            r = y[rows][right].sum(0)
            gain = round(float((r * r / m + (s - r) ** 2 / (n - m) - s * s / n).sum()), 9)
            if gain > best[0]:
                best = (gain, f, int(b))
    return best


def plain(q, y, rows, depth, leaf, choose, node, root, gains, leaves):
    n = len(rows)
    if n >= 2 * leaf and depth > 0 and y[rows].var(0).sum() >= 1e-10:
        _, f, b = split(q, y, rows, choose(node), leaf)
        if f is not None:
            right = q[rows, f] >= b
            parts = rows[~right], rows[right]
            for t in range(y.shape[1]):
                cost = lambda x: x.var() * len(x)
                gains[t, f] += max(0, cost(y[rows, t]) - sum(cost(y[p, t]) for p in parts)) / root
            plain(q, y, parts[0], depth - 1, leaf, choose, 2 * node, root, gains, leaves)
            plain(q, y, parts[1], depth - 1, leaf, choose, 2 * node + 1, root, gains, leaves)
            return
    for i in rows:
        leaves[i] = node


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n, f, t = 120, 6, 5
    q = rng.integers(0, 6, (n, f)) * (rng.random((n, f)) < 0.6) * 40
    y = np.round(np.where(rng.random((n, t)) < 0.7, rng.random((n, t)), 0) + 0.01 * q[:, :t], 3)
    bins = spark.createDataFrame([(i, j, int(q[i, j])) for i in range(n) for j in range(f) if q[i, j]], "cell long, tf long, bin int").cache()
    targets = spark.createDataFrame([(k // 3, i, k, float(y[i, k])) for i in range(n) for k in range(t) if y[i, k]], "batch int, cell long, target long, v double").cache()
    return q, y, bins, targets, spark.range(n).select(F.col("id").alias("cell"))


@pytest.mark.parametrize("looks", [6, 2])
def test_levels_equal_plain_trees(spark, data, looks):
    q, y, bins, targets, cells = data
    batches = targets.select("batch")
    state = T.planted(cells, batches, range(2), 0.8, False, 3).cache()
    grown = T.grow(state, bins, targets, list(range(6)), 3, 5, looks, seed=9)
    got, want = {}, {}
    for r in grown.gains.groupBy("batch", "tree", "target", "tf").agg(F.sum("gain").alias("g")).collect():
        if r.g > 1e-12:
            got[r.batch, r.tree, r.target, r.tf] = round(r.g, 9)
    ends = {(r.batch, r.tree, r.cell): r.node for r in grown.state.where("w > 0").collect()}
    for b, own in ((0, [0, 1, 2]), (1, [3, 4])):
        for t in range(2):
            rows = np.array(sorted(r.cell for r in state.where(f"batch = {b} and tree = {t} and w > 0").collect()))
            assert 0.6 < len(rows) / len(q) < 0.95
            gains, leaves = np.zeros((len(own), 6)), {}
            plain(q, y[:, own], rows, 3, 5, lambda node, b=b, t=t: np.sort(T.chosen(9, b, t, node, np.arange(6), looks)), 1, len(rows), gains, leaves)
            want |= {(b, t, own[i], f): round(gains[i, f], 9) for i in range(len(own)) for f in range(6) if gains[i, f] > 1e-12}
            assert leaves == {c: node for (x, z, c), node in ends.items() if (x, z) == (b, t)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_sibling_is_parent_less_child(spark, data):
    _, _, bins, targets, cells = data
    root = T.planted(cells, targets.select("batch"), [0], 1.0, False, 1)
    halves = root.withColumn("node", F.when(F.col("cell") % 3 == 0, 2).otherwise(3).cast("long"))
    parent, child, other = (T.histogram(s, bins, targets) for s in (root, halves.where("node = 2"), halves.where("node = 3")))
    family = spark.createDataFrame([(b, 0, 3, 2, 1) for b in (0, 1)], "batch int, tree int, node long, small long, parent long")
    rows = lambda df: {(r.batch, r.node, r.tf, r.bin, r.target): (r.n, round(r.s or 0, 9), round(r.ss or 0, 9)) for r in df.collect() if r.target is None or abs(r.s) > 1e-9}
    assert rows(T.subtracted(parent, child, family)) == rows(other)


def test_sampling_with_replacement_and_random_thresholds(spark, data):
    _, _, bins, targets, cells = data
    w = T.planted(spark.range(20_000).select(F.col("id").alias("cell")), targets.select("batch"), [0], 0.632, True, 1).groupBy("batch").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).collect()
    assert all(abs(r.m - 0.632) < 0.02 and abs(r.v - 0.632) < 0.03 for r in w)
    grown = T.grow(T.planted(cells, targets.select("batch"), range(3), 1.0, False, 1), bins, targets, list(range(6)), 1, 5, 6, thresholds=1, seed=5)
    every = T.grow(T.planted(cells, targets.select("batch"), range(3), 1.0, False, 1), bins, targets, list(range(6)), 1, 5, 6, seed=5)
    a, b = ({(r.batch, r.tree): r.gain for r in g.splits.collect()} for g in (grown, every))
    assert a.keys() == b.keys() and all(a[k] <= b[k] + 1e-9 for k in a) and any(a[k] < b[k] - 1e-9 for k in a)


def test_boosting_against_plain_rounds(spark, data):
    q, y, bins, targets, cells = data
    own = targets.where("target < 2").withColumn("batch", F.col("target").cast("int"))
    found = {(r.target, r.tf): r.importance for r in R.boosting_by_levels(bins, own, cells, list(range(6)), trees=2, depth=2, leaf=5, looks=6, subsample=0.8, rate=0.3, seed=11).collect()}
    u = {(b, t): {r.cell for r in cells.where(T.uniform(F.lit(11), F.lit(b), F.lit(t), "cell") < 0.8).collect()} for b in (0, 1) for t in range(2)}
    for b in (0, 1):
        left, total = y[:, [b]].copy(), np.zeros(6)
        for t in range(2):
            rows, gains, at = np.array(sorted(u[b, t])), np.zeros((1, 6)), {}
            plain(q, left, rows, 2, 5, lambda node: np.arange(6), 1, len(rows), gains, at)
            total += gains[0]
            # cells left out follow the splits of the cells that were in: find them by the same walk
            tree = walk(q, left, rows, 2, 5)
            for i in range(len(q)):
                left[i, 0] -= 0.3 * tree(i)
        share = total / total.sum()
        assert all(abs(found.get((b, f), 0) - share[f]) < 1e-8 for f in range(6))


def walk(q, y, rows, depth, leaf):
    """A function that gives a cell the mean of its leaf."""
    if len(rows) >= 2 * leaf and depth > 0:
        _, f, b = split(q, y, rows, range(q.shape[1]), leaf)
        if f is not None:
            right = q[rows, f] >= b
            lo, hi = walk(q, y, rows[~right], depth - 1, leaf), walk(q, y, rows[right], depth - 1, leaf)
            return lambda i: hi(i) if q[i, f] >= b else lo(i)
    mean = y[rows].mean()
    return lambda i: mean


def test_network_finds_the_regulator_and_may_exclude_it(spark):
    rng = np.random.default_rng(8)
    x = rng.random((150, 3)).round(3)
    values = np.column_stack([x, 2 * x[:, 0] + 0.05 * rng.random(150)])
    norm = spark.createDataFrame([(i, g, float(values[i, g])) for i in range(150) for g in range(4)], "cell long, gene long, norm double").cache()
    cells, tfs, targets = norm.select("cell").distinct(), norm.where("gene < 3").select("gene").distinct(), norm.where("gene in (0, 3)").select("gene").distinct()
    for learner, how in (("rf", {"trees": 6, "features": 3}), ("grnboost2", {"trees": 30, "rate": 0.2, "features": 3, "by_levels": False})):
        rows = R.regulatory_network(norm, cells, tfs, targets, learner, depth=2, leaf=5, **how).collect()
        assert len(rows) == 6
        top = {r.gene: r.tf for r in rows if r.importance > 0.5}
        assert top == {0: 0, 3: 0}
    rows = R.regulatory_network(norm, cells, tfs, targets, "grnboost2", 5, 2, 5, features=3, exclude_self=True, by_levels=False).collect()
    assert {(r.gene, r.tf) for r in rows if r.importance == 0} >= {(0, 0)} and next(r.importance for r in rows if (r.gene, r.tf) == (3, 0)) > 0.5
    rows = R.regulatory_network(norm, cells, tfs, targets, "rf", 3, 1, 5, features=3, exclude_self=True).collect()
    assert next(r.importance for r in rows if (r.gene, r.tf) == (0, 0)) == 0 and next(r.importance for r in rows if (r.gene, r.tf) == (3, 0)) > 0.5
    assert R.regulatory_network(norm, cells, tfs, targets.where("gene > 9"), "rf", 2, 2, 5).count() == 0


def test_sparse_bins_boost_as_dense_ones_and_no_targets_are_no_error(spark):
    """Regulators are held by their entries: many empty ones need no room, and a split is the dense one."""
    rng = np.random.default_rng(1)
    q = np.where(rng.random((400, 6)) < 0.3, rng.integers(1, 256, (400, 6)), 0).astype(np.uint8)
    y = q[:, 1] * 0.1 + rng.normal(size=400)
    rows = np.flatnonzero(rng.random(400) < 0.8)
    best = (1e-9, -1, 0)
    for f in range(6):
        for b in range(1, 256):
            right = q[rows, f] >= b
            if min(right.sum(), (~right).sum()) >= 10:
                gain = y[rows][right].sum() ** 2 / right.sum() + y[rows][~right].sum() ** 2 / (~right).sum() - y[rows].sum() ** 2 / len(rows)
                best = max(best, (gain, f, b), key=lambda x: x[0])
    got = R._split(R.Bins.of(q), rows, y, np.arange(6), 10)
    assert abs(got[0] - best[0]) < 1e-6 and got[1:] == best[1:]
    cells = spark.range(20_000).select(F.col("id").alias("cell"))
    bins = spark.createDataFrame([(1, 5, 7)], "cell long, tf long, bin int")
    none = spark.createDataFrame([], "batch int, cell long, target long, v double")
    assert R.boosting_in_tasks(bins, none, cells, list(range(40_000)), trees=1).count() == 0  # 800 MB of dense bins


def test_best_splits_rank_no_rows_of_a_node(spark):
    # all splits of a node were sorted in one window.
    hist = spark.createDataFrame([(0, 0, 1, tf, b, t, 2 if t is None else None, None if t is None else 1.5, None if t is None else 2.0) for tf in (3, 1, 2) for b in (5, 4) for t in (None, 7)], "batch int, tree int, node long, tf long, bin int, target long, n long, s double, ss double")
    sizes = spark.createDataFrame([(0, 0, 1, 10)], "batch int, tree int, node long, n long")
    sums = spark.createDataFrame([(0, 0, 1, 7, 3.0, 4.0)], "batch int, tree int, node long, target long, s double, ss double")
    got = T.best_splits(hist, sizes, sums, 2)
    r = got.collect()
    # 4 of 10 cells hold the whole sum in bins from 4 on: 3^2 / 4 - 3^2 / 10; equal features give the smallest
    assert len(r) == 1 and (r[0].tf, r[0].bin, r[0].n, r[0].n_right) == (1, 4, 10, 4) and abs(r[0].gain - 1.35) < 1e-12
    assert "row_number" not in got._jdf.queryExecution().toString()
