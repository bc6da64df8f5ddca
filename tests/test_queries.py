"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("QUADWEAVE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n.startswith("op_")]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v + 0.0, 6) if isinstance(v, float) else v
    return sorted(tuple(map(repr, (value(r[i]) for i in order))) for r in rows)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    rows = plain(map(tuple, got.collect()), got.columns)
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    expected = plain(want.fetchall(), want.columns)
    # whole doubles and integers compare by value
    number = lambda rows: [tuple(x.removesuffix(".0") for x in r) for r in rows]
    assert number(rows) == number(expected)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["z", "x", "y", "features"] and df.count() > 0


def test_tight_fan_out_does_not_shuffle(spark):
    plan = entry.queries()["op_point_in_tile"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
