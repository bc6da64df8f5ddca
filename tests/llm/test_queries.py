"""Registered queries on the smallest tables: against SQL where there is any, else one row per document."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("QUADWEAVE_TEST_DATA", "/root/testdata/sf0.001")
NAMES = [n for n in entry.queries() if n.startswith("op") and not n.startswith("op_")]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        table = "embeddings" if name.startswith("op3") else "documents"
        assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
        return
    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(sql)
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    pick = lambda rs, names: sorted(repr([r[names.index(c)] for c in order]) for r in rs)
    assert pick(map(tuple, rows), df.columns) == pick(want.fetchall(), want.columns)


def test_ten_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
