"""Operators without an oracle against independent plain forms."""

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helixframe.functions.special import f_sf
from helixframe.operators import enrichment as E, hotspot as H, metacells as A


def test_multi_contrast_is_the_regression_of_membership(spark):
    """With two groups Pillai's trace is the share of the membership's variance that the contrasts explain."""
    rng = np.random.default_rng(2)
    n, d = 60, 3
    x = rng.normal(size=(n, d))
    x[:15, 1] += 1.5
    sets = {"a": range(15), "b": range(10, 40), "small": range(3)}
    contrasts = spark.createDataFrame([(g, f"c{j}", float(x[g, j])) for g in range(n) for j in range(d)], "gene long, contrast string, value double")
    genes = spark.createDataFrame([(s, g) for s, own in sets.items() for g in own], "set_id string, gene long")
    ranks = np.zeros((n, d))
    for r in E.contrast_ranks(contrasts).collect():
        ranks[r.gene, int(r.contrast[1:])] = r["rank"]
    got = {r.set_id: r for r in E.multi_contrast(contrasts, genes).collect()}
    assert set(got) == {"a", "b"}
    for name, r in got.items():
        own = np.isin(np.arange(n), list(sets[name]))
        design = np.column_stack([np.ones(n), ranks])
        left = own - design @ np.linalg.lstsq(design, own.astype(float), rcond=None)[0]
        share = 1 - (left**2).sum() / own.var() / n
        assert abs(r.p - f_sf(share / d / ((1 - share) / (n - d - 1)), d, n - d - 1)) < 1e-9
        assert np.allclose(r.scores, 2 * (ranks[own].mean(0) - ranks[~own].mean(0)) / n)
        for j in range(d):  # one contrast alone: the squared t of the two means
            a, b = ranks[own, j], ranks[~own, j]
            pooled = (a.var() * len(a) + b.var() * len(b)) / (n - 2)
            assert abs(r.p_contrast[j] - f_sf((a.mean() - b.mean()) ** 2 / pooled / (1 / len(a) + 1 / len(b)), 1, n - 2)) < 1e-9
    assert got["a"].p < 0.01


def test_signature_autocorrelation(spark):
    rng = np.random.default_rng(5)
    n = 30
    score = {"near": np.sort(rng.normal(size=n)).round(1), "far": rng.normal(size=n).round(1)}
    back = {f"bg{i}": rng.normal(size=n).round(1) for i in range(9)}
    edges = [(i, j, float(round(rng.random() + 0.1, 2))) for i in range(n) for j in ((i + 1) % n, (i + 2) % n)]

    def consistency(x):
        order = sorted(x)
        r = np.array([np.mean([i + 1 for i, v in enumerate(order) if v == own]) for own in x])
        c = (n - 1) * sum(w * (r[i] - r[j]) ** 2 for i, j, w in edges) / (2 * sum(w for *_, w in edges) * ((r - r.mean()) ** 2).sum())
        return 1 - c

    rows = lambda sets: spark.createDataFrame([(i, s, float(x[i]), 0) for s, x in sets.items() for i in range(n)], "cell long, set_id string, score double, cluster int")
    w = spark.createDataFrame(edges, "src long, dst long, w double")
    got = {r.set_id: r for r in H.signature_autocorrelation(rows(score), rows(back), w).collect()}
    null = [consistency(x) for x in back.values()]
    for s, x in score.items():
        assert abs(got[s].consistency - consistency(x)) < 1e-9
        assert abs(got[s].p - (1 + sum(b >= consistency(x) for b in null)) / 10) < 1e-12


def test_bootstrap_metacells_share_few_cells(spark):
    rng = np.random.default_rng(1)
    nn = [(i, r + 1, int(j)) for i in range(80) for r, j in enumerate(rng.choice([x for x in range(80) if x != i], 6, replace=False))]
    df = spark.createDataFrame([(i, r, j, float(r)) for i, r, j in nn], "id long, rank int, nbr long, dist double")
    groups: dict[int, set] = {}
    for r in A.bootstrap_metacells(df, 2, 12).collect():
        groups.setdefault(r.metacell, set()).add(r.cell)
    own = list(groups.values())
    assert 2 <= len(own) <= 12
    assert all(len(a & b) <= 2 for i, a in enumerate(own) for b in own[:i])
    near = {i: {j for k, _, j in nn if k == i} for i in range(80)}
    assert all(any(g in (near[i], near[i] | {i}) for i in range(80)) for g in own)
    assert all(a != b for a, b in pairwise(own)) and df.where(F.col("id") == 0).count() == 6


def test_archetypes_of_a_sparse_kernel(spark):
    """More cells than a dense kernel could hold; and the products of the sparse one against dense ones."""
    n = 21_000
    ring = spark.range(n).select("id", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.pmod(F.col("id") + s, F.lit(n)).alias("nbr"), F.lit(1.0 + abs(s)).alias("dist")) for i, s in enumerate((-2, -1, 1, 2))])).alias("x")).select("id", "x.*")
    out, rss = A.archetypes(ring, 5, rounds=2, steps=5, min_rounds=1)
    assert out.count() == n and rss[-1] <= rss[0]
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((60, 60)) < 0.1, rng.random((60, 60)), 0)
    dense = np.maximum(dense, dense.T)
    np.fill_diagonal(dense, 1)
    k = A.Kernel(*np.nonzero(dense), dense[np.nonzero(dense)])
    x = rng.random((60, 3))
    assert np.allclose(k @ x, dense @ x)
    assert np.allclose(k.square_norms(), ((dense @ dense) ** 2).sum(0))
    sq, left, want = dense @ dense, dense @ dense, []
    for _ in range(4):  # the greedy choice on what the chosen columns leave of the square
        score = np.where(np.diag(left) > 1e-10, (left**2).sum(0) / np.maximum(np.diag(left), 1e-10), -np.inf)
        score[want] = -np.inf
        want.append(int(score.argmax()))
        basis = sq[:, want]
        left = sq - basis @ np.linalg.solve(basis[want], basis.T)
    assert A.greedy_centres(k, 4) == want


def test_controls_are_drawn_from_the_own_bin(spark):
    """As many different genes of the bin as asked for; no gene meets its whole bin, which took over a minute here."""
    import time

    from helixframe.operators import cells as C

    n = 12_000
    bins = spark.range(n).select(F.col("id").alias("gene"), F.when(F.col("id") < 7, 1).otherwise(0).alias("bin"))
    start = time.time()
    sets = bins.select(F.col("gene").cast("string").alias("set_id"), "gene")
    got = C.control_genes(sets, bins, 20, 1).groupBy("set_id").agg(F.collect_list("gene").alias("g")).collect()
    assert time.time() - start < 40
    assert len(got) == n
    for r in got:
        own = {g < 7 for g in r.g}
        assert own == {int(r.set_id) < 7} and len(set(r.g)) == len(r.g) == (7 if int(r.set_id) < 7 else 20)


def test_doublet_axes_take_any_number_of_genes(spark):
    """More genes than a Gram matrix on the driver had room for; on few genes the axes are those of the plain decomposition."""
    from helixframe.operators import doublets as B

    wide = spark.range(9_000).select((F.col("id") % 40).alias("cell"), F.col("id").alias("gene"), (F.col("id") % 7 + 1).cast("int").alias("raw"))
    load, shift = B.axes(wide, 40, 3, 100.0, True)
    assert load.count() == 9_000 and len(shift) == 3
    rng = np.random.default_rng(1)
    raw = rng.poisson(1, (80, 3)) @ rng.poisson(2, (3, 12)) + rng.poisson(0.5, (80, 12)) + 1
    counts = spark.createDataFrame([(i, j, int(raw[i, j])) for i in range(80) for j in range(12)], "cell long, gene long, raw int")
    got = B.embed(counts, counts.select((-F.col("cell") - 1).alias("cell"), "gene", "raw"), B.axes(counts, 80, 3, 50.0, True), 50.0, True)
    vec = {r.id: np.array(r.vec) for r in got.collect()}
    x = np.log1p(raw / raw.sum(1, keepdims=True) * 50)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    y = np.stack([vec[i] for i in range(80)])
    assert np.allclose(np.abs(u[:, :3].T @ y), np.diag(s[:3]), atol=1e-6)
    assert all(np.allclose(vec[i], vec[-i - 1]) for i in range(80))


def test_kernel_densities_in_batches(spark):
    """Genes of several sizes side by side, by both kernels, against sums written out; a batch of genes is one call, not a group each."""
    import math

    from helixframe.operators import enrichment as E

    rng = np.random.default_rng(8)
    rows = [(g, f"s{s}", float(rng.integers(0, 300))) for g in range(40) for s in range(1 + g % 5)]
    for gaussian in (True, False):
        plan = E.kernel_density(spark.createDataFrame(rows, "gene long, sample string, value double"), gaussian)
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
        got = {(r.gene, r.sample): r.value for r in plan.collect()}
        assert len(got) == len(rows)
        for g, s, a in rows:
            x = [v for h, _, v in rows if h == g]
            if gaussian:
                width = max(np.std(x, ddof=1) / 4 if len(x) > 1 else 0.0, 0.001)
                left = [0.5 * math.erfc(-(a - b) / width / math.sqrt(2)) for b in x]
            else:
                left = [sum(math.exp(i * math.log(b + 0.5) - b - 0.5 - math.lgamma(i + 1)) for i in range(int(a) + 1)) for b in x]
            t = min(sum(left) / len(left), 1.0)
            assert abs(got[g, s] + math.log((1 - t) / max(t, 1e-15))) < 1e-7


def test_gower_and_widths_in_blocks(spark):
    """Pairs of blocks give what pairs of rows do: of rows that lack entries, over several blocks, and without a table of pairs."""
    from helixframe.operators import similarity as S, stats as Z

    rng = np.random.default_rng(4)
    rows = [(i, c, float(rng.integers(0, 9))) for i in range(60) for c in "abc" if rng.random() < 0.7]
    m, kinds = spark.createDataFrame(rows, "row long, col string, value double"), spark.createDataFrame([("a", True), ("b", False), ("c", False)], "col string, is_cat boolean")
    before, S.BLOCK = S.BLOCK, 7
    try:
        got = {(r.row_a, r.row_b): r.value for r in S.gower(m, kinds).collect()}
    finally:
        S.BLOCK = before
    have = {i: {c: v for j, c, v in rows if j == i} for i in range(60)}
    span = {c: max(v for _, d, v in rows if d == c) - min(v for _, d, v in rows if d == c) for c in "bc"}
    want = {}
    for i, x in have.items():
        for j, y in have.items():
            own = [float(x[c] != y[c]) if c == "a" else abs(x[c] - y[c]) / span[c] for c in sorted(x.keys() & y.keys())]
            if i < j and own:
                want[i, j] = sum(own) / len(own)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    v = rng.normal(size=(50, 4))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {(r.epsilon, r.id): r.total for r in Z.rbf_scan_cosine(points, (0.5, 2.0), block=9).collect()}
    for e in (0.5, 2.0):
        k = np.exp(-((e * (1 - u @ u.T)) ** 2))
        assert all(abs(found[e, i] - (k[i].sum() - k[i, i])) < 1e-9 for i in range(50))
    assert Z.rbf_scan_cosine(points.where("id = 1"), (0.5,)).count() == 0


def test_geary_joins_edges_once_for_many_sets(spark, monkeypatch):
    # each edge was joined once for each set. A cell without a score of a set leaves that set's edges out.
    rng = np.random.default_rng(8)
    x = rng.random((6, 5))
    kept = [(c, f"s{k}", float(x[c, k])) for c in range(6) for k in range(5) if (c, k) != (2, 3)]
    edges = [(0, 1, 1.0), (1, 2, 0.5), (2, 3, 2.0), (4, 5, 1.5), (0, 5, 1.0)]
    monkeypatch.setattr(H, "SIDE_BY_SIDE", 2)
    got = {r.set_id: r.c for r in H.geary(spark.createDataFrame(kept, "cell long, set_id string, score double"), spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    for k in range(5):
        use = [c for c in range(6) if (c, k) != (2, 3)]
        own = [(a, b, w) for a, b, w in edges if a in use and b in use]
        n, v = len(use), x[use, k].var()
        want = sum(w * (x[a, k] - x[b, k]) ** 2 for a, b, w in own) * (n - 1) / (2 * sum(w for *_, w in own) * v * n)
        assert abs(got[f"s{k}"] - want) < 1e-12


def test_sums_of_matrix_go_in_order_of_the_file(spark, tmp_path):
    # partial sums of files met in any order; 0.1 + (0.2 + 0.3) is not (0.1 + 0.2) + 0.3.
    from helixframe import tables as T

    spark.createDataFrame([(1, 5, 2.0)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    for name, values in (("a", [0.1]), ("b", [0.2, 0.3])):
        rows = pd.DataFrame({"l_partkey": 1, "l_quantity": 1.0, "l_extendedprice": values, "l_discount": values})
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        rows.to_parquet(tmp_path / "lineitem.parquet" / f"{name}.parquet", index=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.col: r.value for r in T.matrix(spark, str(tmp_path), True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["revenue"] == (0.1 + 0.2) + 0.3 and got["discount"] == ((0.1 + 0.2) + 0.3) / 3 and got["lines"] == 3.0 and got["quantity"] == 3.0


def test_neighbours_of_short_vectors_by_boxes(spark, monkeypatch):
    # F5 to F9: all pairs of cells were compared, and products of large coordinates left distances of 0 at 1e-4.
    from helixframe.operators import neighbours as N

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(450, 2)) * [3000, 2], 1) + [1e6, 0]
    x = np.vstack([x, x[:50], x[:50], np.repeat(x[:1], 40, 0)])  # copies: ties that the ids break
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)], "id long, vec array<double>")
    ids = np.array([r.id for r in points.collect()])
    monkeypatch.setattr(N, "IN_BOX", 64)
    met, boxed = [], N._boxed
    monkeypatch.setattr(N, "_boxed", lambda *a: met.append(1) or boxed(*a))
    got = {}
    for r in N.knn(points, 4, "euclidean").collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.nbr, r.dist)
    assert met and len(got) == len(x)
    for i, v in zip(ids, x, strict=True):
        d = np.round(np.sqrt(((v - x) ** 2).sum(1)), 12)
        want = [j for j in np.lexsort((ids, d)) if ids[j] != i][:4]
        assert [got[i][r + 1][0] for r in range(4)] == ids[want].tolist()
        assert np.abs([got[i][r + 1][1] for r in range(4)] - d[want]).max() < 1e-9


def test_module_scores_send_a_count_to_its_cell_once(spark):
    # F16: a row for each count and set of its gene was shuffled.
    import re

    from helixframe.operators import cells as C

    norm = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 2, 5.0), (3, 9, 1.0)], "cell long, gene long, norm double")
    sets = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "set_id string, gene long")
    controls = spark.createDataFrame([("a", 2), ("b", 1), ("b", 2)], "set_id string, gene long")
    df = C.module_scores(norm, sets, controls)
    assert {(r.cell, r.set_id): r.score for r in df.collect()} == {(1, "a"): 1.0 - 3.0, (1, "b"): 3.0 - 2.5, (2, "a"): -5.0, (2, "b"): 5.0 - 2.5}
    assert not re.search(r"hashpartitioning\(cell#\d+L?, (n|set_id)#", df._jdf.queryExecution().executedPlan().toString())
