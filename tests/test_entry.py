"""The driver's contract, and every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from loamdex.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def held_against_sql(con, df, sql):
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in df.columns]
    wanted = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted((plain(r) for r in rows), key=repr) == sorted((plain(r) for r in wanted), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    held_against_sql(con, registry.queries()[name](spark, SF), registry.oracle_sql().get(name))


@pytest.mark.parametrize("name", sorted(registry.literals()))
def test_typed_rows(spark, con, name):
    query, sql = registry.literals()[name]
    held_against_sql(con, query(spark, SF), sql)
