"""All-pairs searches send a row to a bounded number of blocks; near ties are settled by the order's digits."""

import numpy as np

from helixframe.operators import neighbours as N


def test_blocks_do_not_grow_with_the_rows():
    assert [N._blocks(n, 4096) for n in (0, 4096, 8193)] == [1, 1, 3]
    assert max(N._blocks(n, 4096) for n in (60_000, 600_000, 1_500_000)) <= N.BLOCKS


def test_a_tie_in_the_digits_goes_to_the_smaller_id():
    a, b = np.zeros((1, 1)), np.array([[1.0], [1.0 + 1e-14], [1.0 - 1e-14], [3.0]])
    ready = lambda x: N._ready(x, "euclidean")
    got = set()
    for part in N._best_of(ready(a), np.array([9]), ready(b), np.array([1, 2, 3, 4]), 1, "euclidean", True):
        got |= set(part["nbr"])
    assert got == {1, 2, 3}


def test_shelves_hold_every_cell(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(300, 4)))], "id long, vec array<double>")
    centre = rng.normal(size=(30, 4))
    placed = N._keyed(points, N._near_cells(centre, 1)).selectExpr("id", "vec", "rb as cell")
    got = {tuple(r)[:3] for r in N._shelved(points, placed, centre, 30, 5, "euclidean", True, 100).collect()}
    assert got == {tuple(r)[:3] for r in N.knn(points, 5, "euclidean").collect()}
