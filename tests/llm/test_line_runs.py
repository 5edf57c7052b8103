"""Line dedup against plain loops."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from loamdex.llm import line_runs
from loamdex.llm.common import ascii_lower

from .data import SF, docs, table

A, B, C = "Some line that repeats in many of the documents", "another line, of more than forty code points", "x" * 39
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """rows: (doc_id, text). Returns sorted (doc_id, n_lines, n_dropped, digest)."""
    held = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    at = lambda i: -(1 << 63) if i is None else i
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(at(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or at(i) == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, h1 string, p int")
    return sorted(map(tuple, line_runs.digests(df, **settings).collect()), key=repr)


def test_edges(spark):
    rows = [(i, f"{A}\nown {i}\n  {A.upper()}\t\n{C}") for i in range(1, 7)]
    rows += [(10, None), (11, ""), (12, "\n"), (None, A), (None, f"{B}\n{A}"), (None, None), (20, A.replace("S", "ſ")), (3, f"{B}\r"), (3, f"{B}\r")]
    rows += [(i, f"\x0b{B} \n\n{C}\n{C}y") for i in (30, 31, 32)] + [(32, B.upper()), (33, "É" + B), (34, "é" + B)]
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, batches=1) == want
    assert found(spark, rows, batches=9, fanout=2) == want
    assert sum(r[2] for r in want) > 10


def test_random_tables_and_long_texts(spark):
    r = random.Random(5)
    pool = [f"{'Lorem ipsum dolor sit amet consectetur'} {i} {'Ä' if i % 3 else 'a'}" for i in range(40)]
    rows = [(r.choice([None, *range(60)]), "\n".join(r.choice(pool) for _ in range(r.randrange(9)))) for _ in range(300)]
    rows.append((1000, "\n".join(r.choice(pool) for _ in range(30_000))))
    rows.append((-5, "\n".join(r.choice(pool) for _ in range(30_000))))
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_one_very_common_line(spark):
    rows = [(i, f"{A}\n{'own words of this text, and more of them'} {i}") for i in range(2000)]
    out = found(spark, rows)
    assert out == plain(rows) and sum(r[2] for r in out) == 1999


def test_runs_settle_and_compact(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    batch = lambda ids, key: spark.createDataFrame([(i, key, 0) for i in ids], "doc long, h1 long, h2 long")
    runs.add(batch(range(90, 96), 1).union(batch([95], 2)))
    runs.add(batch(range(80, 86), 1).union(batch([80], 2)))  # key 1 is settled: only key 2 is added
    assert runs.compacted == 1 and [len(x) for x in runs.levels] == [0, 1]
    assert sorted(map(tuple, spark.table(runs.runs()[0]).collect())) == [(1, 0, 6, 95), (2, 0, 2, 95)]
    runs.add(batch([1, 2, 3], 2))
    assert sorted(map(tuple, runs.repeated().collect())) == [(1, 0, 95), (2, 0, 95)]
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_merged_without_moving_them(spark):
    runs = line_runs.LineRuns(spark)
    own = spark.range(100).selectExpr("id AS doc", "id % 7 AS h1", "id % 3 AS h2").repartition(4)
    runs.add(own)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.unsettled(own)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs.drop()
    # One exchange for distinct documents, one for the sums of a key, both of the batch; the join is above them.
    assert plan.index("SortMergeJoin") < plan.index("HashAggregate") and plan.count("Exchange hashpartitioning") == 2


def test_lower_case_of_a_to_z_only(spark):
    chars = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([("Ab" + c,) for c in chars], "t string")
    bad = df.filter(ascii_lower(df.t) != F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert bad.count() == 0


def test_whole_table_against_loops(spark):
    t = table(spark, "documents")
    out = sorted(map(tuple, line_runs.digests(t).collect()), key=repr)
    assert out == plain([(r.doc_id, r.text) for r in t.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert out == sorted(con.execute(line_runs.oracle()).fetchall(), key=repr)


def test_native(spark):
    plan = line_runs.digests(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
