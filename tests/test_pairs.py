"""Neighbours over all pairs: cells of the grid, copies, and what is shuffled."""

import numpy as np
import pytest

from loamdex.operators import cluster, pairs


def table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")


def units(n, width, seed):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("tile", [(512, 2048), (7, 300)])
def test_all_pairs_of_a_grid(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    v = np.concatenate([units(900, 5, 1), np.tile(units(1, 5, 2), (40, 1)), np.zeros((1, 5))])
    v = v[np.random.default_rng(3).permutation(len(v))]
    once, which = np.unique(v, axis=0, return_inverse=True)
    sims = (once @ once.T)[which.ravel()][:, which.ravel()]
    far = -sims
    np.fill_diagonal(far, np.inf)
    rows = {r.a: r for r in cluster.neighbours(table(spark, v), 3, block=100).collect()}
    assert len(rows) == len(v)
    for i, r in rows.items():
        assert [x.b for x in r.near] == list(np.argsort(far[i], kind="stable")[:3])
        others = np.delete(sims[i], i)
        assert r.n == len(v) - 1 and r.s == pytest.approx(others.sum(), abs=1e-9) and r.ss == pytest.approx((others**2).sum(), abs=1e-9)


def test_rows_are_sent_to_a_fixed_number_of_cells():
    """Not to as many as there are blocks, until sides are full."""
    assert [pairs.sides(n, 128) for n in (0, 100, 1000, 100_000, 600_000)] == [1, 1, 8, 12, 12]
    assert pairs.sides(10 * pairs.SIDE * pairs.SIDES, 128) == 10 * pairs.SIDES


def test_few_rows_and_none(spark):
    rows = [*map(tuple, spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", None)], "id string, v array<double>").collect())]
    found = cluster.neighbours(spark.createDataFrame(rows, "id string, v array<double>"), 2)
    assert sorted((r.a, [x.b for x in r.near], r.n) for r in found.collect()) == [("a", ["b"], 1), ("b", ["a"], 1)]
    assert cluster.neighbours(table(spark, units(5, 2, 1)).limit(0)).collect() == []
