import pytest

from conftest import rows
from edaspark.operators import duplicates as d
from edaspark.operators.validate import issues, null_counts

DATA = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (2, 2, float("nan")), (2, 2, None), (3, 3, 1.0)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(DATA, "a int, b int, x double")


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_counts_and_removal(monkeypatch, df, broadcast):
    monkeypatch.setattr(d, "BROADCAST_HASHES", broadcast)
    assert d.duplicate_count(df) == 2
    kept = rows(d.remove_duplicates(df))
    assert sorted(kept, key=repr) == sorted([(1, None, 0.0), (None, 1, 0.0), (2, 2, None), (3, 3, 1.0)], key=repr)
    assert sorted(r["copies"] for r in d.duplicate_groups(df).collect()) == [2, 2]


def test_colliding_hashes_are_told_apart(monkeypatch, df):
    monkeypatch.setattr(d, "_hashed", lambda frame: frame.selectExpr("*", "7L as row_hash"))
    assert d.duplicate_count(df) == 2
    assert d.remove_duplicates(df).count() == 4


def test_unique_rows_pass_unshuffled(spark):
    df = spark.range(100)
    assert d.remove_duplicates(df).count() == 100
    assert "Exchange" not in d.remove_duplicates(df)._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    assert d.duplicate_count(spark.range(0)) == 0


def test_issue_tables(df):
    assert rows(null_counts(df)) == [(0, "a", 1), (1, "b", 2), (2, "x", 2)]
    assert ("duplicates", None, "2") in rows(issues(df))
    assert ("data_types", "x", "double") in rows(issues(df))


def test_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, 2), (1, 2)], "copies int, count int")
    assert d.duplicate_count(df) == 1
    assert d.top_duplicates(df).columns == ["copies", "count", "copies_"]
