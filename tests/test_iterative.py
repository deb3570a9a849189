"""Every query without an oracle runs and keeps its invariants."""

import pytest

from helixframe import catalog
from helixframe.plans import iterative


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    for r in rows:
        d = r.asDict()
        for key in ("p", "fdr", "vote", "share", "recall"):
            if key in d and d[key] is not None:
                assert -1e-9 <= d[key] <= 1 + 1e-9


def test_page_rank_sums_to_one(spark, sf):
    assert abs(sum(r["rank"] for r in iterative.QUERIES["page_rank"](spark, sf).collect()) - 1) < 1e-7


def test_approximate_neighbours_are_good(spark, sf):
    for r in iterative.QUERIES["knn_recall"](spark, sf).collect():
        assert r.recall >= 0.9, r


def test_importances_sum_to_one(spark, sf):
    import pyspark.sql.functions as F

    for name in ("regulatory_network", "regulatory_network_boosted"):
        for r in iterative.QUERIES[name](spark, sf).groupBy("gene").agg(F.sum("importance").alias("s")).collect():
            assert abs(r.s - 1) < 1e-6 or r.s == 0


def test_community_scores_after_driver_use(spark):
    """The tail runs in workers although lgamma was called on the driver before; against exact sums."""
    import math

    from helixframe.functions import special
    from helixframe.operators.doublets import community_scores

    assert abs(float(special.lgamma(5.0)) - math.log(24)) < 1e-12
    assert abs(float(special.normal_cdf(0.0)) - 0.5) < 1e-12
    made = [(i if i > 3 else -1 - i, i % 2) for i in range(12)]
    got = {r.cell: (r.share, r.log_p) for r in community_scores(spark.createDataFrame(made, "id long, community int")).collect()}
    for cell, community in made:
        if cell >= 0:
            ids = [i for i, c in made if c == community]
            s, k, m, t = sum(i < 0 for i in ids), len(ids), 4, 12
            p = sum(math.comb(m, x) * math.comb(t - m, k - x) for x in range(s, min(k, m) + 1)) / math.comb(t, k)
            assert got[cell][0] == s / k and abs(got[cell][1] - min(0.0, math.log(p))) < 1e-9


def test_page_rank_is_settled_to_its_digits(spark, sf):
    """A further round of the registered query's ranks moves none of them."""
    import numpy as np

    e = iterative._und(spark, sf).toPandas()
    ids = sorted(set(e.src))
    p = np.zeros((len(ids), len(ids)))
    np.add.at(p, (e.src.map(ids.index), e.dst.map(ids.index)), e.w)
    got = {r.id: r["rank"] for r in iterative.QUERIES["page_rank"](spark, sf).collect()}
    r = np.array([got[i] for i in ids])
    assert np.abs(0.15 / len(ids) + 0.85 * (p / p.sum(1, keepdims=True)).T @ r - r).max() < 3e-9
