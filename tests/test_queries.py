"""Every registered query against its SQL, on the smallest tables, and without pairing whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import FOLDER, TABLES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def ordered(found):
    return sorted(found, key=repr)


# Queries of the subpackage that can be left out have tests of their own.
@pytest.mark.parametrize("name", entry.QUERIES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns = sorted(df.columns)
    mine = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    assert mine
    if name in entry.oracle_sql():
        result = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        theirs = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()])
        assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
