import numpy as np

from loamdex.llm import multi_index
from tests.llm.data import table


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        own = np.flatnonzero(ids == q)[0]
        near, distance = multi_index.nearest(ids, x, x[own], q, k)
        out[int(q)] = list(zip(near.tolist(), distance.tolist(), strict=True))
    return out


def test_recall_and_exact_scores(spark):
    vectors = table(spark, "embeddings")
    rows = vectors.toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    true = brute(ids, x, ids[ids % 20 == 0])
    found = {}
    for r in multi_index.search(vectors, every=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == true.keys()
    hits = 0
    for q, near in found.items():
        assert [r for r, _, _ in near] == list(range(1, 11))
        assert [(s, i) for _, i, s in near] == sorted((s, i) for _, i, s in near)
        for _, i, s in near:
            assert s == float(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum()))
        hits += len({i for _, i, _ in near} & {i for i, _ in true[q]})
    assert hits >= 0.9 * 10 * len(true)


def test_walk_is_ordered_and_complete():
    rng = np.random.default_rng(3)
    left, right, counts = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
    pairs = multi_index.walk(left, right, counts, 10**9)
    assert len(set(pairs)) == len(pairs) == 35
    sums = [left[a] + right[b] for a, b in pairs]
    assert sums == sorted(sums)


def test_unusable_ties_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = multi_index.search(vectors, part=1.0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert multi_index.search(vectors.limit(0)).count() == 0
    assert multi_index.search(vectors.filter("vec_id = 0")).count() == 0


def test_groups_and_repeated_rows(spark, monkeypatch):
    """Several groups, one of several shards; rows of one id are candidates of their own; few ids over many rows."""
    monkeypatch.setattr(multi_index, "SHARD", 40)
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(size=(100, 4)), np.tile(rng.normal(size=4), (200, 1))]), 3)
    rows = [(i % 150, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = multi_index.search(frame.dropDuplicates(["vec_id"]).union(frame.filter("vec_id % 50 <> 0")), part=1.0, every=50, centroids=8).collect()
    assert {r.query_id for r in found} == {0, 50, 100} and len(found) == 30
    assert all(r.vec_id != r.query_id for r in found)
    one = multi_index.search(spark.createDataFrame([(7 * (i % 2), [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<double>"), sample=20, part=1.0).collect()
    assert len(one) == 10 and {r.vec_id for r in one} == {7}


def test_arrange():
    rng = np.random.default_rng(6)
    counts = np.array([5, 0, 90, 12, 3, 30, 1, 8])
    group, shards = multi_index.arrange(rng.normal(size=(8, 3)), counts, 25)
    for g, n in enumerate(shards):
        held = counts[group == g].sum()
        assert held <= 25 if n == 1 else held <= 25 * n
    assert set(group) == set(range(len(shards)))
