"""Neighbour descent and the moments of similarities against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.operators import cluster, descent


def table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")


def units(n, width, seed):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_all_pairs_up_to_a_block(spark):
    v = units(90, 6, 1)
    found = {r.a: [x.b for x in r.near] for r in descent.neighbours(table(spark, v), 4).collect()}
    far = -(v @ v.T)
    np.fill_diagonal(far, np.inf)
    assert found == {i: list(np.argsort(far[i])[:4]) for i in range(90)}


def test_recall_beyond_it(spark):
    """Vectors without clusters, in many blocks."""
    v = units(3000, 16, 2)
    far = -(v @ v.T)
    np.fill_diagonal(far, np.inf)
    found = {r.a: {x.b for x in r.near} for r in descent.neighbours(table(spark, v), 3, block=128).collect()}
    assert len(found) == 3000
    assert sum(len(found[i] & set(np.argsort(far[i])[:3])) for i in range(3000)) >= 0.9 * 9000


def test_copies_and_few_rows(spark):
    same = np.tile([[1.0, 0.0]], (700, 1))
    rows = descent.neighbours(table(spark, same), 2, block=64).collect()
    assert len(rows) == 700 and all(len(r.near) == 2 and r.a not in [x.b for x in r.near] for r in rows)
    assert [(r.a, list(r.near)) for r in descent.neighbours(table(spark, same[:1]), 2).collect()] == [(0, [])]
    assert descent.neighbours(table(spark, same[:0]), 2).collect() == []


@pytest.mark.parametrize("n", [2, 300])
def test_moments(spark, n):
    v = units(n, 7, 3) + 0.2
    sims = (v @ v.T)[~np.eye(n, dtype=bool)]
    row = descent.moments(table(spark, v)).first()
    assert row.n == len(sims) and row.mean == pytest.approx(sims.mean()) and row.deviation == pytest.approx(sims.std(), abs=1e-6)


def test_no_moments_of_one_row(spark):
    assert descent.moments(table(spark, units(1, 3, 4))).first().mean is None


def test_edges_are_those_of_all_pairs(spark):
    rows = table(spark, units(200, 8, 5))
    wanted = cluster.mutual_edges(cluster.neighbours(rows, 3)).collect()
    assert sorted(map(tuple, descent.mutual_edges(rows, 3).collect())) == sorted(map(tuple, wanted))
    assert rows.filter(F.col("id") < 0).count() == 0 == descent.mutual_edges(rows.limit(0)).count()


def test_exact_edges_beyond_a_block(spark):
    """Of vectors without clusters, of which descent misses some, and with copies."""
    v = np.concatenate([units(1500, 24, 6), np.tile(units(1, 24, 7), (20, 1))])
    rows = table(spark, v)
    wanted = cluster.mutual_edges(cluster.neighbours(rows, 3)).collect()
    found = descent.mutual_edges(rows, 3, exact=True, block=64, rounds=0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted))
