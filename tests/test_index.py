"""A saved neighbour index: the same answers after it is read again, recall, and its use in neighbourhood sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import neighbours as N


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 16)) + rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] * 2
    x[100:160] = x[100]  # a group of copies larger than a block
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()


def test_saved_index(spark, points, tmp_path):
    path = f"{tmp_path}/index"
    N.save_index(points, path, "euclidean", block=25)
    later = points.where("id % 3 = 0").withColumn("vec", F.transform("vec", lambda x: x + 0.01)).withColumn("id", F.col("id") + 10_000)
    ask = lambda **how: sorted((r.id, r.rank, r.nbr) for r in N.search_index(spark, path, later, 8, **how).collect())
    first = ask()
    assert first == ask()
    exact = {(r.id, r.nbr) for r in N.knn(later, 8, "euclidean", points).collect()}
    assert len(exact & {(i, n) for i, _, n in first}) / len(exact) >= 0.9
    assert {(i, n) for i, _, n in ask(probes=10_000)} == exact
    own = {(r.id, r.nbr) for r in N.search_index(spark, path, points, 5, own=True, probes=10_000).collect()}
    assert own == {(r.id, r.nbr) for r in N.knn(points, 5, "euclidean").collect()}
    assert spark.read.parquet(f"{path}/vectors").groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 50


def test_sampling_by_index_equals_brute_force_with_all_cells(points, tmp_path):
    nn = N.knn(points, 6, "euclidean").cache()
    path = f"{tmp_path}/index"
    N.save_index(points, path, "euclidean", probes=10_000)
    picked = lambda **how: {r["index"] for r in N.sample_neighbourhoods(points, nn, **how).collect()}
    assert picked(strategy="index", index=path) == picked(strategy="bruteforce")


@pytest.mark.parametrize("method", ["annoy", "ivf", "nndescent"])
def test_recall_of_tuned_methods(points, method):
    exact = N.knn(points, 10, "euclidean")
    assert N.recall(N.knn(points, 10, "euclidean", method=method), exact).first().recall >= 0.93


def test_descent_stores_lists_and_no_candidates(spark, monkeypatch):
    """No stored table of the descent exceeds the lists, both ways; distances are those of the vectors."""
    from helixframe.operators import neighbours as M

    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 6))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    sizes, plain = [], M.cut

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(M, "cut", counted)
    got = M.knn(points, 3, "euclidean", method="nndescent").collect()
    assert max(sizes) <= 400 * 2 * 6 and len(got) == 1200
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    assert all(abs(r.dist - d[r.id, r.nbr]) < 1e-6 for r in got)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :3]
    assert np.mean([r.nbr in near[r.id] for r in got]) > 0.9
