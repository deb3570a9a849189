"""Near vectors against brute force."""

import numpy as np
import pytest

from helixframe.llm import embeddings

ODD = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [None] * 64), (9005, [1.0, 2.0]), (9005, [1.0, 2.0]), (9006, [2.0, 4.1]), (9007, []), (9008, [float("inf")] + [1.0] * 63), (None, [3.0] * 64)]


@pytest.fixture(scope="module")
def table(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return d.union(spark.createDataFrame(ODD, "vec_id long, embedding array<float>"))


def test_links_match_brute_force(table):
    got = embeddings.near_vectors(table).collect()
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect() if r.vec_id is not None and r.vec_id < 9000]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    comp = dict(zip(ids, ids))
    for _ in range(len(ids)):
        new = {i: min([comp[i], *(comp[ids[j]] for j in np.flatnonzero(near[n]))]) for n, i in enumerate(ids)}
        if new == comp:
            break
        comp = new
    count = dict(zip(ids, near.sum(1).tolist()))
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        if r.vec_id is not None and r.vec_id < 9000:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)


def test_odd_rows(table):
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(table).where("vec_id > 9000").collect())
    want = [(i, 0, i) for i in (9001, 9002, 9003, 9004, 9007, 9008)] + [(9005, 2, 9005)] * 2 + [(9006, 2, 9005)]
    assert got == sorted(want)
    assert embeddings.near_vectors(table.where("false")).count() == 0


def test_large_bucket_is_dealt_to_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist()) for i in range(300)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=64).collect()
    assert all(r.n_links == 299 and r.component_id == 0 for r in got)


def test_estimates_are_unbiased_and_bounded():
    """Estimates of pairs at many cosines, over many rotations: their mean, and the bound at the threshold."""
    rng = np.random.default_rng(2)
    for cosine in (0.0, 0.5, 0.9, 0.99):
        gaps = []
        for seed in range(40):
            t = embeddings.Tables(1000, 0.9, 200, 1e-4, seed=100 + 3 * seed)
            a, b = rng.normal(size=(100, 64)), rng.normal(size=(100, 64))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            b -= (a * b).sum(1, keepdims=True) * a
            b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
            (x1, y1, s1, f1), (x2, y2, s2, f2) = (t.vectors(t.codes(v), 64) for v in (a, b))
            gap = ((x1 * y2).sum(1) + (y1 * x2).sum(1)) / 2 - cosine
            gaps.append(gap)
            p = np.arccos(cosine) / np.pi
            assert abs((s1 * s2).mean() - (1 - 2 * p)) < 0.06
            if cosine >= 0.9:
                assert (gap > -embeddings.SIGMAS * t.error(np.minimum(f1, f2), 64)).all()
        gaps = np.array(gaps)
        assert abs(gaps.mean()) < 5 * gaps.mean(1).std() / 40**0.5 + 1e-3


def test_codes_rule_pairs_out(sf):
    """Few pairs are left to the exact cosine, and none that is near is ruled out."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    v = np.array([x for x in pq.read_table(f"{sf}/../sf0.01/embeddings.parquet").column("embedding").to_pylist() if x], float)
    v = np.vstack([v, v[:100] + 0.03 * rng.normal(size=(100, 64)) * np.linalg.norm(v[:100], axis=1, keepdims=True)])
    unit = embeddings._unit(v)
    t = embeddings.Tables(len(v), 0.9, 200, 1e-4)
    left = {(int(p), int(q)) for i, j in t.candidates(t.codes(unit), 64, None) for p, q in zip(i, j)}
    near = {(int(p), int(q)) for p, q in np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))}
    assert len(near) >= 100 and near <= left and len(left) < 130


def test_clashing_columns_are_ignored(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(embeddings.near_vectors(d.select("vec_id", "embedding")).collect())
    more = d.selectExpr("vec_id", "embedding", "1 as v", "2 as cid", "'x' as code", "3 as n_links", "4 as block", "5 as h1")
    assert sorted(embeddings.near_vectors(more).collect()) == want
