"""Small hand-checked cases and planted structure."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import columns as K
from helixframe.functions import special as X
from helixframe.operators import cells as C
from helixframe.operators import decomposition as D
from helixframe.operators import doublets as B
from helixframe.operators import enrichment as E
from helixframe.operators import fusion as U
from helixframe.operators import graph as G
from helixframe.operators import matrix as M
from helixframe.operators import neighbours as N
from helixframe.operators import ontology as O
from helixframe.operators import regulation as R
from helixframe.operators import similarity as S
from helixframe.operators import stats as Z
from helixframe.operators.loess import Loess
from helixframe.sources import formats, store
from helixframe.streaming import ingest


def test_fdr(spark):
    # Inputs and results that any right implementation shares.
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "idx int, p double")
    assert [round(r.fdr, 9) for r in K.with_fdr(df, "p").orderBy("idx").collect()] == [0.03, 0.04, 0.04]


def test_average_rank(spark):
    # Inputs and results that any right implementation shares.
    df = spark.createDataFrame(list(enumerate([3.0, 1.0, 2.0, 3.0])), "id int, x double")
    got = df.select("id", K.average_rank("x").alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [3.5, 1.0, 2.0, 3.5]
    assert df.where("id < 0").select(K.average_rank("x")).collect() == []


def test_z_pvalues():
    assert np.allclose(X.z_pvalue([0, 1.95996398454]), [1, 0.05], atol=1e-9)
    assert np.allclose(X.z_pvalue([1.6448536], "greater"), 0.05, atol=1e-6)
    assert np.allclose(X.z_pvalue([-1.6448536], "less"), 0.05, atol=1e-6)
    assert 0 < X.z_pvalue([37.5])[0] < 1e-300
    with pytest.raises(ValueError):
        X.z_pvalue([0], "sideways")


def test_special_functions():
    assert abs(X.digamma(1) + 0.5772156649015329) < 1e-12
    assert abs(X.trigamma(1) - math.pi**2 / 6) < 1e-8
    assert abs(X.trigamma(6, True) - X.trigamma(6)) < 1e-3
    assert abs(X.beta_inc(2, 3, 0.4) - 0.5248) < 1e-10
    assert abs(X.beta_quantile(0.5248, 2, 3) - 0.4) < 1e-8
    assert abs(X.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(X.chi2_sf(2.0, 2) - math.exp(-1)) < 1e-12
    assert abs(X.f_sf(4.964602743730711, 1, 10) - 0.05) < 1e-9
    assert X.hypergeom_sf(0, 5, 5, 5) == 1.0
    assert abs(X.hypergeom_sf(1, 5, 5, 5) - (1 - (1 + 25) / 252)) < 1e-12


def test_outliers(spark):
    # Inputs and results that any right implementation shares.
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, 3.0, 4.0, 100.0])), "id int, x double")
    about = Z.median_mad(df, "x").first()
    assert (about["median"], about.mad) == (3.0, 1.0)
    flags = {r.x: r.outlier for r in Z.mad_outliers(df, "x", 3).collect()}
    assert flags == {1.0: False, 2.0: False, 3.0: False, 4.0: False, 100.0: True}
    assert not any(r.outlier for r in Z.mad_outliers(df, "x", 3, "below").collect())
    with pytest.raises(ValueError):
        Z.mad_outliers(df, "x", 3, "sideways")


def test_critical_value_and_split(spark):
    df = spark.range(1000).select(F.col("id").alias("x"))
    assert 900 < Z.critical_value(df, "x", 2000, 0.05).first().critical < 990
    a, b = Z.random_split(df, "x", 300)
    assert (a.count(), b.count()) == (300, 700) and a.join(b, "x").count() == 0


def test_cell_components(spark):
    rng = np.random.default_rng(9)
    x = rng.poisson(0.6, (40, 8)).astype(float)
    rows = [(i, j, float(x[i, j])) for i in range(40) for j in range(8) if x[i, j]]
    got = D.cell_components(spark.createDataFrame(rows, "cell long, gene long, norm double"), 40, 3).collect()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    for r in got:
        assert np.allclose(np.abs(r.vec), np.abs((u * s)[r.id, :3]), atol=1e-6)


def test_set_similarity(spark):
    a = spark.createDataFrame([("x", "A"), ("x", "B")], "set_id string, item string")
    b = spark.createDataFrame([("y", "B"), ("y", "C")], "set_id string, item string")
    assert abs(S.set_similarity(a, b).first().value - 1 / 3) < 1e-12
    assert S.set_similarity(a, b, True).first().value == 0.5
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4])], "a array<int>, b array<int>")
    assert df.select(K.jaccard(F.col("a"), F.col("b")).alias("j")).first().j == 0.5


def test_reciprocal_best_none(spark):
    sim = spark.createDataFrame([("a", "b", 0.2)], "set_a string, set_b string, value double")
    assert [tuple(r) for r in S.reciprocal_best(sim, 0.5).collect()] == [("NA", "NA", 0.0)]
    assert [tuple(r) for r in S.reciprocal_best(sim, 0.1).collect()] == [("a", "b", 0.2)]


def test_topological_overlap(spark):
    # Inputs and results that any right implementation shares.
    a = [[1, 1, 1], [1, 1, 0], [1, 0, 1]]
    m = spark.createDataFrame([(i, j, float(a[i][j])) for i in range(3) for j in range(3) if a[i][j]], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in S.topological_overlap(m).collect()}
    assert abs(got[0, 1] - 0.5) < 1e-12 and abs(got[1, 2] - 1 / 3) < 1e-12


def test_pmi_of_equal_columns(spark):
    m = spark.createDataFrame([(0, "a"), (0, "b")], "row int, col string")
    assert abs(S.pmi(m, 2, True).first().value - 1) < 1e-12


def barbell(spark):
    e = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    return G.both_ways(spark.createDataFrame([(a, b, 1.0) for a, b in e], "src long, dst long, w double"))


@pytest.mark.parametrize("find", [lambda e: G.louvain(e), lambda e: G.walktrap(e, 3, 2, "average"), lambda e: G.walktrap(e, 3, 2, "complete")])
def test_barbell_communities(spark, find):
    # Inputs and results that any right implementation shares.
    got = {r.id: r.community for r in find(barbell(spark)).collect()}
    assert got[0] == got[1] == got[2] != got[3] == got[4] == got[5]


def test_page_rank_star(spark):
    # Inputs and results that any right implementation shares.
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0)], "src long, dst long, w double")
    got = {r.id: r["rank"] for r in G.page_rank(e).collect()}
    assert abs(got[1] - got[2]) < 1e-12 and abs(sum(got.values()) - 1) < 1e-12 and got[1] > got[0]


def test_components_and_hops(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)] + [(20, 21, 1.0)], "src long, dst long, w double")
    comp = {r.id: r.component for r in G.connected_components(e).collect()}
    assert {comp[i] for i in range(10)} == {0} and comp[21] == 20
    hops = {r.id: r.hops for r in G.hop_distances(e, spark.createDataFrame([(2,)], "id long")).collect()}
    assert hops == {i: i - 2 for i in range(2, 10)}


def test_mutual_neighbours(spark):
    left = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0])], "id long, vec array<double>")
    right = spark.createDataFrame([(0, [0.1, 0.0]), (1, [5.1, 5.0])], "id long, vec array<double>")
    assert sorted((r.left, r.right) for r in N.mutual_neighbours(left, right, 1).collect()) == [(0, 0), (1, 1)]


def test_sparse_ranks(spark):
    # Inputs and results that any right implementation shares.
    v = spark.createDataFrame([(0, 0, 1.0), (0, 2, 3.0), (1, 1, 2.0)], "cell long, gene long, norm double")
    got = {(r.cell, r.gene): (r["rank"], r.zero_rank) for r in C.ranks_within(v, "cell", 3).collect()}
    assert got == {(0, 0): (2.0, 1.0), (0, 2): (3.0, 1.0), (1, 1): (3.0, 1.5)}


def test_loess_recovers_a_parabola():
    x = np.linspace(0, 1, 60)
    y = 1 + 2 * x - 3 * x**2
    assert np.abs(Loess(0.3, 2).fit(x, y).fitted - y).max() < 1e-6
    assert Loess(0.5, 1).fit(np.array([1.0, np.nan]), np.array([2.0, 1.0])).fitted[1] == 0
    with pytest.raises(ValueError):
        Loess(0, 2)


def test_pca_and_svd_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)) @ np.diag([5, 3, 1, 0.5, 0.3, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(D.randomised_svd(df, 3)[0], s[:3], rtol=1e-6)
    centred = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(D.pca(df, 3)[2], centred[:3], rtol=1e-6)
    a = x.T @ x
    assert np.allclose(D.lanczos(lambda v: a @ v, 6, 3)[0], s[:3] ** 2, rtol=1e-6)


def test_sparse_svd_matches_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(0.5, (40, 8)).astype(float)
    rows = [(i, j, float(x[i, j])) for i in range(40) for j in range(8) if x[i, j]]
    df = spark.createDataFrame(rows, "cell long, gene long, norm double")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(D.sparse_svd(df, 40, 3)[0], np.linalg.svd(z, compute_uv=False)[:3], rtol=1e-8)


def test_ica_unmixes():
    rng = np.random.default_rng(2)
    s = np.vstack([np.sign(np.sin(np.linspace(0, 40, 2000))), rng.uniform(-1, 1, 2000)])
    x = np.array([[1, 0.5], [0.3, 1]]) @ s
    x = x - x.mean(1, keepdims=True)
    w, v = np.linalg.eigh(np.cov(x))
    white = np.diag(w**-0.5) @ v.T @ x
    for kind in D.ICA:
        un, change = D.fast_ica(white, rng.normal(size=(2, 2)), kind)
        c = np.abs(np.corrcoef(np.vstack([un @ white, s]))[:2, 2:])
        assert c.max(1).min() > 0.97 and change < 1e-3


def test_sylvester():
    rng = np.random.default_rng(3)
    for n in (5, 40):
        a, b = (q @ q.T + np.eye(n) for q in (rng.normal(size=(n, n)) / n for _ in range(2)))
        x = rng.normal(size=(n, n))
        assert np.allclose(D.sylvester(a, b, a @ x + x @ b, 400, 1e-10), x, atol=1e-3)


def test_enrichment_of_planted_set(spark):
    stats = spark.createDataFrame([(i, float(200 - i) / 100 - 1) for i in range(200)], "gene long, stat double")
    sets = spark.createDataFrame([("top", i) for i in range(10)] + [("mixed", i) for i in range(5, 200, 20)], "set_id string, gene long")
    got = {r.set_id: r for r in E.gsea(stats, sets, 200).collect()}
    assert got["top"].es > 0.9 and got["top"].p < 0.02 and got["mixed"].p > 0.05
    multi = {r.set_id: r for r in E.gsea_multilevel(stats, sets, 51).collect()}
    assert multi["top"].p < 1e-6 < multi["mixed"].p
    assert E.multilevel_error(1e-3, 101) > 0 and E.simple_error(5, 1000) > 0


def test_prefix_scores_match_running_sum():
    rng = np.random.default_rng(4)
    w, drawn = np.abs(rng.normal(size=50)), rng.permutation(50)[:8]
    for k, es in enumerate(E.prefix_scores(w, drawn), 1):
        hit = np.isin(np.arange(50), drawn[:k])
        walk = np.cumsum(np.where(hit, w / w[hit].sum(), -1 / (50 - k)))
        hi, lo = max(walk.max(), 0), min(walk.min(), 0)
        assert abs(es - (hi if hi > -lo else lo)) < 1e-9


def test_ontology_cycle_raises(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "parent string, child string, w double")
    with pytest.raises(ValueError):
        O.ancestors(e)


def test_elimination_keeps_the_specific_term(spark):
    edges = spark.createDataFrame([("root", "leaf", 0.8), ("root", "other", 0.8)], "parent string, child string, w double")
    genes = [("root", g) for g in range(100)] + [("leaf", g) for g in range(12)] + [("other", g) for g in range(50, 80)]
    tg = spark.createDataFrame(genes, "term string, gene long")
    target = spark.createDataFrame([(g,) for g in range(12)], "gene long")
    got = {r.term: r for r in O.elimination(tg, O.ancestors(edges), O.levels(edges), target).collect()}
    assert got["leaf"].p < 1e-8 and got["root"].hits == 0


def test_boosting_finds_the_regulator():
    rng = np.random.default_rng(5)
    q = rng.integers(0, 256, (200, 3)).astype(np.uint8)
    y = 2.0 * q[:, 0] + rng.normal(size=200)
    assert R.boosting(q, y, 50, 3, 10, 3, 0.9, 0.1, 10, 1)[0] > 0.8


def test_otsu_and_gap(spark):
    x = np.concatenate([np.random.default_rng(6).normal(0, 0.1, 200), np.random.default_rng(7).normal(2, 0.1, 50)])
    assert 0.2 < B.otsu(x) < 1.9
    s = spark.createDataFrame([(0.1,), (0.2,), (0.9,), (1.0,)], "score double")
    assert B.largest_gap(s).first().cutoff == 0.9
    assert B.adjusted_k(0, 100, 200) == 15


def test_fusion_needs_two_views(spark):
    with pytest.raises(ValueError):
        U.fuse([spark.createDataFrame([(0, 0, 1.0)], "row long, col long, value double")])


def test_dictionary_fits():
    rng = np.random.default_rng(8)
    y = rng.normal(size=(12, 3)) @ rng.normal(size=(3, 20))
    m = U.Dictionary(sparsity=3, size=3, k=3, alpha=0.01, beta=0.01)
    d, x = m.fit(y)
    assert m.objectives(y, d, x)["error"] < 0.5 * (y**2).sum()
    assert ((x != 0).sum(0) <= 3).all()


def test_matrix_reshaping(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "row long, col long, value double")
    stacked = M.bind_rows([(a, 2), (a, 2)])
    assert stacked.agg(F.max("row")).first()[0] == 3
    assert M.bind_cols([(a, 2), (a, 2)]).agg(F.max("col")).first()[0] == 3
    lists = M.to_lists(a, 2)
    assert {r.row: list(r["values"]) for r in lists.collect()} == {0: [1.0, 2.0], 1: [0.0, 3.0]}
    assert M.from_dense(M.from_lists(lists)).count() == 3
    assert M.drop_row(a, 0).collect()[0].row == 0
    assert M.subtract(a, a).count() == 0


def test_hvg_stub():
    with pytest.raises(NotImplementedError):
        C.variable_genes(None, 10, method="dispersion")


def test_store_round_trip(spark, tmp_path):
    counts = formats.synthetic_cells(spark, 50, 60).select("cell", "gene", "raw")
    path = str(tmp_path / "store")
    store.write(counts, path)
    assert store.read(spark, path).count() == store.read(spark, path, "genes").count() == counts.count()
    got = store.read_ids(spark, path, [7, 3]).select("cell", "pos").distinct()
    assert {(r.cell, r.pos) for r in got.collect()} == {(7, 0), (3, 1)}
    assert store.read_range(spark, path, 5, 8).select("cell").distinct().count() == 3
    assert store.header(spark, path).first().version == 3
    with pytest.raises(ValueError):
        store.migrate(spark, path, str(tmp_path / "new"))
    assert store.library_sizes(spark, path).count() == 50 and store.gene_nnz(spark, path).count() <= 60


def test_matrix_market(spark, tmp_path):
    f = tmp_path / "x.mtx"
    f.write_text("%%MatrixMarket matrix coordinate integer general\n% note\n3 2 3\n1 1 5\n2 2 70000\n3 1 1\n")
    assert sorted(map(tuple, formats.matrix_market(spark, str(f)).collect())) == [(0, 0, 5), (1, 1, 70000), (2, 0, 1)]
    assert sorted(map(tuple, formats.matrix_market(spark, str(f), False).collect())) == [(0, 0, 5), (0, 2, 1), (1, 1, 70000)]


def test_stream_summary(spark, tmp_path):
    formats.synthetic_cells(spark, 20, 30).select("cell", "gene", "raw").write.parquet(str(tmp_path / "in"))
    q = ingest.start_summary(ingest.counts_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), "summary_table")
    q.awaitTermination()
    assert spark.table("summary_table").count() == 20


def test_stream_summary_table(spark, tmp_path):
    """Two arrivals: keys of both keep the later state, and a batch that runs again changes nothing."""
    first, second = [(1, 1, 5), (1, 2, 6), (2, 1, 1)], [(1, 3, 4), (3, 1, 2)]
    for rows in (first, second):
        spark.createDataFrame(rows, "cell long, gene long, raw int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start_summary_table(ingest.counts_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, ingest.latest_summary(spark, str(tmp_path / "out")).collect()))
    assert got == [(1, 3, 15), (2, 1, 1), (3, 1, 2)]


@pytest.mark.parametrize("left", ["nothing", "folder"])
def test_entry_without_training_data_package(tmp_path, left):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tmp_path / "copy"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    if left == "folder":
        (to / "helixframe" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries())[:3], len(e.oracle_sql()))"], cwd=to, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(to)})
    assert out.returncode == 0, out.stderr


def test_fdr_over_ranges_is_the_global_one(spark):
    from helixframe.functions.columns import with_fdr
    from helixframe.operators.stats import fdr_over_ranges

    rng = np.random.default_rng(3)
    made = [(i, float(round(p, 2))) for i, p in enumerate(rng.random(500) ** 2)] + [(1000, None), (1001, 0.0), (1002, 1.0)]
    df = spark.createDataFrame(made, "i int, p double").repartition(5)
    want = {r.i: r.fdr for r in with_fdr(df.where("p is not null"), "p").collect()}
    got = {r.i: r.fdr for r in fdr_over_ranges(df, "p").collect()}
    assert got.pop(1000) is None and got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def _plain_loess(x, y, span, degree, most=64):
    """Local regression point by point."""
    order = np.argsort(x, kind="stable")
    xs, ys, n = x[order], y[order], len(x)
    k = min(n, max(int(np.ceil(span * n)), degree + 1))
    out, lo = np.zeros(n), 0
    for i in range(n):
        while lo + k < n and xs[i] - xs[lo] > xs[lo + k] - xs[i]:
            lo += 1
        u, v = xs[lo : lo + k], ys[lo : lo + k]
        d = np.abs(u - xs[i])
        reach = d.max()
        if reach <= 1e-12:
            out[order[i]] = v.mean()
            continue
        if k > most:
            at = np.arange(most) if k >= n else np.argsort(d, kind="stable")[:most]
            u, v, d = u[at], v[at], d[at]
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        out[order[i]] = np.polyfit(u - xs[i], v, degree, w=np.sqrt(w))[-1]
    return out


def test_loess_is_the_plain_one():
    rng = np.random.default_rng(4)
    for n, span, degree in [(300, 0.3, 2), (120, 0.5, 1), (500, 0.2, 2), (40, 0.9, 2)]:
        x = np.round(rng.random(n) * 10, 2)
        y = np.sin(x) + rng.normal(0, 0.1, n)
        assert np.abs(Loess(span, degree).fit(x, y).fitted - _plain_loess(x, y, span, degree)).max() < 1e-6


def test_loess_does_not_lay_out_its_windows():
    """A third of the points is in each window: laid out and sorted, 60,000 points took over half a minute."""
    import time

    rng = np.random.default_rng(5)
    x = rng.normal(size=60_000)
    start = time.process_time()
    fitted = Loess(0.3, 2).fit(x, 1 + x * x).fitted
    assert time.process_time() - start < 20
    assert np.abs(fitted - 1 - x * x).max() < 1e-6
    tied = np.round(rng.normal(size=600), 1)
    y = rng.normal(size=600)
    assert np.abs(Loess(0.4, 2).fit(tied, y).fitted - _plain_loess(tied, y, 0.4, 2)).max() < 1e-6


def test_fusion_of_full_tables_is_that_of_dense_squares(spark, monkeypatch):
    # each update joined all pairs twice with the neighbours of a node.
    monkeypatch.setattr(U, "STRIP", 3 * 13)
    monkeypatch.setattr(M, "matmul", None)
    rng, n = np.random.default_rng(3), 13
    views = [x + x.T for x in rng.random((3, n, n)) + 0.05]

    def status(x):
        x = x * (1 - np.eye(n))
        return x / (2 * x.sum(1, keepdims=True)) + np.eye(n) / 2

    def near(x):
        top = np.argsort(-x, axis=1, kind="stable")[:, :4]
        out = np.zeros((n, n))
        np.put_along_axis(out, top, np.take_along_axis(x, top, 1), 1)
        return out / out.sum(1, keepdims=True)

    w, p = [near(x) for x in views], [status(x) for x in views]
    for _ in range(2):
        for i in range(3):
            p[i] = status(w[i] @ (sum(p[j] for j in range(3) if j != i) / 2) @ w[i].T)
    want = sum(p) / 3
    want = want / want.sum(1, keepdims=True)
    want = (want + want.T) / 2
    np.fill_diagonal(want, 1.0)
    tables = [spark.createDataFrame([(10 * i, 10 * j, float(x[i, j])) for i in range(n) for j in range(n)], "row long, col long, value double") for x in views]
    got = U.fuse(tables, 4, 2).collect()
    assert len(got) == n * n and all(abs(r.value - want[r.row // 10, r.col // 10]) < 1e-12 for r in got)


def test_loess_takes_whole_windows():
    # at most 64 of a window's points entered a fit.
    rng = np.random.default_rng(6)
    for n, span, degree, digits in [(400, 0.5, 2, 2), (300, 0.6, 1, 1), (500, 1.0, 2, 9), (40, 0.9, 2, 1)]:
        x = np.round(rng.random(n) * 10, digits)
        y = np.sin(x) + rng.normal(0, 0.1, n)
        assert np.abs(Loess(span, degree, None).fit(x, y).fitted - _plain_loess(x, y, span, degree, n)).max() < 1e-6
    assert not Loess(0.5, 2, None).fit(np.zeros(0), np.zeros(0)).fitted.size
    assert Loess(1.0, 2, None).fit(np.ones(3), np.arange(3.0)).fitted.tolist() == [1.0, 1.0, 1.0]


def test_variable_genes_fit_all_genes_of_a_window(spark):
    # a far gene of a window has to count.
    from helixframe.operators import cells as C

    rng = np.random.default_rng(7)
    rows = [(c, g, int(v)) for g in range(300) for c, v in enumerate(rng.poisson(1 + g / 20, 12)) if v]
    got = {r.gene: r for r in C.variable_genes(spark.createDataFrame(rows, "cell long, gene long, raw int"), 12).collect()}
    genes = sorted(got)
    x, y = (np.log10([got[g][c] for g in genes]) for c in ("mean", "var"))
    want = 10 ** _plain_loess(x, y, 0.3, 2, len(genes))
    assert len(genes) * 0.3 > 64 and np.abs([got[g].expected for g in genes] - want).max() < 1e-6
