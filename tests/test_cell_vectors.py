"""Vectors by cell against the search of all vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.operators import cell_vectors, vector

SF = "/root/testdata/sf0.001"


def clustered(n, width=12, centres=20, seed=1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, width))
    return [(i, i // 3, [float(x) for x in middle[i % centres] + r.normal(size=width) * 0.15]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, vector array<float>")


def rows(df):
    return [(r.rank, r.chunk_id, r.doc_id, round(r.score, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    extra = [(9000, 5, [0.0] * 12), (9001, 6, None), (9002, 7, [float("nan")] * 12)]
    data = table(spark, clustered(2000) + extra)
    cell_vectors.build(data, path)
    return path, data


def test_exact_search_is_that_of_all_vectors(spark, saved):
    path, data = saved
    index = cell_vectors.load(spark, path)
    for q in (data.first().vector, [1.0] * 12, [-0.3, 1.0] * 6, [0.0] * 12):
        for k, offset in ((1, 0), (10, 0), (10, 5)):
            wanted = rows(vector.search(data.filter("chunk_id <> 9002"), vector.literal(q), k, offset))
            assert rows(cell_vectors.search(index, q, k, offset, F.col("chunk_id") != 9002, exact=True)) == wanted


def test_a_search_reads_few_files(spark, saved):
    path, data = saved
    index = cell_vectors.load(spark, path)
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    q = list(data.filter("chunk_id = 77").first().vector)
    near, reach = index.near(q, 0.1), index.reaching(q, 0.9)
    every = files(index.vectors)
    assert files(index.vectors.filter(F.col("cell").isin(near))) < 0.3 * every and len(reach) < 0.5 * len(index.cells)
    assert "PartitionFilters: [cell" in index.vectors.filter(F.col("cell").isin(near))._jdf.queryExecution().executedPlan().toString()
    found = {r[1] for r in rows(cell_vectors.search(index, q, 20, share=0.1))}
    assert len(found & {r[1] for r in rows(vector.search(data.filter("chunk_id < 9000"), vector.literal(q), 20))}) >= 18


def test_recall_on_vectors_without_clusters(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    cell_vectors.build(e, str(tmp_path))
    index, queries = cell_vectors.load(spark, str(tmp_path)), [list(r.vector) for r in e.filter("chunk_id % 50 = 0").collect()]
    hit = sum(len({r[1] for r in rows(cell_vectors.search(index, q, 10, share=0.6))} & {r[1] for r in rows(vector.search(e, vector.literal(q), 10))}) for q in queries)
    assert hit >= 0.9 * 10 * len(queries)


def test_update_writes_the_touched_cells(spark, tmp_path):
    data, path = clustered(600), str(tmp_path)
    cell_vectors.build(table(spark, data), path, cells=12)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "chunks").iterdir()}
    fresh = [(5000, 3, [5.0] * 12), (9, 3, data[9][2])]
    n = cell_vectors.update(spark, path, table(spark, fresh), table(spark, data).filter("doc_id IN (3, 4)").select("doc_id"))
    kept = [x for x in data if x[1] not in (3, 4)] + fresh
    index = cell_vectors.load(spark, path)
    assert sorted((r.chunk_id, r.doc_id) for r in index.vectors.collect()) == sorted((a, b) for a, b, _ in kept)
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "chunks").iterdir() if f.name.startswith("cell=")}
    assert 0 < n < 12 and sum(after[f] != before.get(f) for f in after) <= n
    assert int(index.sizes.sum()) == len(kept)
    for q in random.Random(3).sample([x[2] for x in kept], 4):
        assert rows(cell_vectors.search(index, q, 5, exact=True)) == rows(vector.search(table(spark, kept), vector.literal(q), 5))


def test_a_cell_may_become_empty_and_a_table_too(spark, tmp_path):
    path = str(tmp_path)
    cell_vectors.build(table(spark, [(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])]), path, cells=2)
    cell_vectors.update(spark, path, table(spark, []), table(spark, [(1, 1, [])]).select("doc_id"))
    assert rows(cell_vectors.search(cell_vectors.load(spark, path), [1.0, 1.0], 5, exact=True)) == [(1, 2, 2, round(0.5**0.5, 9))]
