"""Hard negatives against all pairs."""

import math
import random

import duckdb
import pytest

from loamdex.llm import voronoi_join

from .data import SF, table

LONG = (-(1 << 63), (1 << 63) - 1)


def plain(rows):
    """rows: (vec_id, label, vector). Returns the sorted result by comparing all anchors with all rows."""
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        ok[i] = min(ok.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in ok.items()}
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), LONG[0]), LONG[1])
    out = []
    for i, (label, v) in whole.items():
        if i % 100:
            continue
        others = sorted((-score(v, w), j, other) for j, (other, w) in whole.items() if j != i)
        for p, j, _ in [x for x in others if x[2] == label][:5]:
            fit = [x for x in others if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<double>, cell string, d double")
    return sorted(map(tuple, voronoi_join.mine(df).collect()))


def clustered(r, n, width, centres, spread):
    at = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, r.randrange(4), [c + r.gauss(0, spread) for c in r.choice(at)]) for i in range(n)]


@pytest.mark.parametrize("seed, centres, spread", [(1, 30, 0.05), (2, 1, 1.0), (3, 8, 0.2)])
def test_random_tables(spark, seed, centres, spread):
    rows = clustered(random.Random(seed), 2500, 8, centres, spread)
    want = plain(rows)
    assert found(spark, rows) == want and len(want) > 100


def test_bounds_leave_cells_out_and_groups_are_many(spark, monkeypatch):
    """With few rows in the sample, floors are low and the bounds decide; results don't depend on them."""
    rows = clustered(random.Random(4), 4000, 6, 40, 0.02)
    monkeypatch.setattr(voronoi_join, "SAMPLE", 300)
    monkeypatch.setattr(voronoi_join, "BLOCK", 16)
    monkeypatch.setattr(voronoi_join, "GROUP", 1)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    kept = voronoi_join.prepared(df).cache()
    sp = voronoi_join.space(kept)
    cells = voronoi_join.assigned(kept, sp)
    sp = voronoi_join._with_bounds(cells, sp)
    anchors = cells.filter("vec_id % 100 = 0").withColumn("bands", voronoi_join.F.lit(None).cast("array<struct<positive_id: long, score: long>>"))
    groups = voronoi_join._groups(anchors, sp, 40, 5)
    used, g = voronoi_join.needed(groups, sp).count(), groups.count()
    assert g > 1 and used < 0.8 * g * len(sp.pivots)
    assert found(spark, rows) == plain(rows)


def test_edges(spark):
    r = random.Random(6)
    rows = clustered(r, 420, 3, 5, 0.3)
    rows[100] = (100, None, [1.0, 1.0, 1.0])
    rows += [(None, 1, [1.0, 2.0, 3.0]), (500, 2, None), (501, 2, [1.0, None, 2.0]), (502, 2, [math.nan, 1.0, 1.0]), (503, 2, [math.inf, 0.0, 0.0]), (504, 2, [1e308, 0.0, 0.0])]
    rows += [(600, 3, [1.0]), (601, 3, [2.0, 1.0, 1.0, 5.0]), (700, 1, []), (-100, 9, [0.5, 0.5, 0.5]), (-7, 9, [0.1, 0.0, 0.2]), (0, 1, [0.0, 0.0, 0.0])]
    rows += [rows[5], (5, 0, [9.0, 9.0, 9.0]), *[(1000 + i, i % 3, [0.25, 0.25, 0.25]) for i in range(900)]]  # repeats, ties
    want = plain(rows)
    assert found(spark, rows) == want and want


def test_large_numbers(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(2), [r.uniform(-1, 1) * 10 ** r.choice([0, 4, 6, 9]) for _ in range(4)]) for i in range(250)]
    assert found(spark, rows) == plain(rows)


def test_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    assert found(spark, [(100, 1, [1.0]), (2, 1, [1.0])]) == []


def test_whole_table_against_sql(spark):
    out = sorted(map(tuple, voronoi_join.mine(table(spark, "embeddings")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert out == sorted(con.execute(voronoi_join.oracle()).fetchall()) and out
