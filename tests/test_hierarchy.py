"""Interval numbers of the path tree against the paths themselves."""

import random

import pytest
from pyspark.sql import functions as F

from loamdex.operators import graph, hierarchy


def rows(seed, n=300):
    r = random.Random(seed)
    part = lambda: r.choice(["a", "a b", "a\x01", "b", "ab", None, "é"])
    return [(i, r.choice(["s", "t"]), r.choice([None, [], *[[part() for _ in range(r.randrange(1, 5))] for _ in range(8)]])) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    given = rows(1)
    docs = spark.createDataFrame(given, "doc_id long, source string, hierarchy array<string>")
    path = str(tmp_path_factory.mktemp("tree"))
    hierarchy.build(docs, path)
    return given, docs, hierarchy.load(spark, path)


def test_ranges_are_subtrees(data):
    given, _, tree = data
    placed = {r.doc_id: r for r in tree.collect()}
    paths = {i: (s, p) for i, s, p in given if p}
    assert set(placed) == set(paths)
    for i, (s, p) in paths.items():
        wanted = {j for j, (t, q) in paths.items() if t == s and q[: len(p)] == p}
        assert {j for j, r in placed.items() if placed[i].lo <= r.lo <= placed[i].hi} == wanted


def test_families(data):
    given, _, tree = data
    paths = {i: (s, p) for i, s, p in given if p}
    sizes = {r.doc_id: (r.siblings, r.parents) for r in hierarchy.family_sizes(tree).collect()}
    below = {r.doc_id: r.below for r in hierarchy.subtree_sizes(tree).collect()}
    for i, (s, p) in paths.items():
        beside = sum(1 for j, (t, q) in paths.items() if j != i and t == s and len(p) > 1 and len(q) == len(p) and q[:-1] == p[:-1])
        above = sum(1 for t, q in paths.values() if t == s and len(p) > 1 and q == p[:-1])
        assert sizes[i] == (beside, above) and below[i] == sum(1 for t, q in paths.values() if t == s and q[: len(p)] == p and q != p)


def test_related_is_the_same_by_the_tree(spark, data):
    given, docs, tree = data
    docs = docs.withColumn("hierarchy", F.transform("hierarchy", lambda x: F.coalesce(x, F.lit("?"))))  # paths without nulls, for the other way
    placed = hierarchy.place(docs)
    links = spark.createDataFrame([(1, 2), (5, 1), (9, 3)], "src long, dst long")
    for i in [g[0] for g in given[:12]]:
        assert graph.related(docs, links, i, 7, placed).collect() == graph.related(docs, links, i, 7).collect()


def test_a_request_reads_one_range(data):
    _, _, tree = data
    plan = hierarchy.subtree(tree, 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lo), GreaterThanOrEqual(lo,3), LessThanOrEqual(lo,9)]" in plan


def test_no_paths(spark):
    docs = spark.createDataFrame([(1, "s", None), (2, "s", [])], "doc_id long, source string, hierarchy array<string>")
    assert hierarchy.place(docs).collect() == [] and hierarchy.relatives(hierarchy.place(docs), 1, 0.9, 0.7) is None
