import numpy as np
import pytest
from pyspark.sql import functions as F

from edaspark.operators import quantiles as q

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]


def samples():
    random = np.random.default_rng(5)
    return {
        "spread": random.normal(size=6000),
        "ties": random.integers(0, 5, 6000).astype(float),
        "heavy": np.where(random.random(6000) < 0.6, 7.0, random.pareto(0.5, 6000)),
        "constant": np.full(6000, 0.1),
        "steps": np.round(random.normal(size=6000), 1),
    }


@pytest.fixture(scope="module")
def wide(spark):
    data = samples()
    rows = [tuple(float(data[c][i]) for c in data) for i in range(6000)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).cache()


def expected(name):
    return list(np.quantile(samples()[name], PROBS))


@pytest.mark.parametrize("small", [50_000, 0])
def test_columns_match_numpy(monkeypatch, wide, small):
    monkeypatch.setattr(q, "SMALL_ROWS", small)
    found = q.column_quantiles(wide, {c: F.col(c) for c in wide.columns}, PROBS)
    for c in wide.columns:
        assert found[c] == pytest.approx(expected(c), abs=1e-12)


@pytest.mark.parametrize("margin,inside", [(1e-5, 10**9), (0.05, 20), (0.0025, 20)])
def test_missed_and_narrowed_brackets_stay_exact(wide, margin, inside):
    numbered = wide.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate(wide.columns)])
    counts, brackets = q._sketch_columns(numbered, list(range(5)), PROBS, margin)
    found = q._exact_columns(numbered, counts, brackets, PROBS, margin, inside)
    for i, c in enumerate(wide.columns):
        assert found[i] == pytest.approx(expected(c), abs=1e-12)


@pytest.mark.parametrize("margin,inside", [(0.0025, 10**9), (1e-5, 10**9), (0.05, 20)])
def test_groups_match_numpy(wide, margin, inside):
    long = wide.unpivot([], wide.columns, "name", "x")
    found = {r["name"]: r for r in q._sketched(long, ["name"], "x", PROBS, margin, inside).collect()}
    for c in wide.columns:
        assert found[c]["n"] == 6000
        assert list(found[c]["q"]) == pytest.approx(expected(c), abs=1e-12)


def test_groups_beyond_the_broadcast_limit(monkeypatch, spark):
    from edaspark import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [("hot" if i % 2 else f"g{i % 7}", float(i)) for i in range(400)]
    found = q._sketched(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0.5]).collect()
    for r in found:
        assert r["q"][0] == np.quantile([x for g, x in rows if g == r["g"]], 0.5)
    assert len(found) == 8


def test_nulls_are_left_out_and_all_null_gives_none(monkeypatch, spark):
    monkeypatch.setattr(q, "SMALL_ROWS", 0)
    df = spark.createDataFrame([(None, None), (1.0, None), (4.0, None)], "x double, y double")
    found = q.column_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, [0.5])
    assert found == {"x": [2.5], "y": [None]}


def test_more_columns_than_one_pass_takes(monkeypatch, spark):
    monkeypatch.setattr(q, "SMALL_ROWS", 0)
    monkeypatch.setattr(q, "COLUMNS_AT_ONCE", 2)
    df = spark.range(101).selectExpr(*[f"double(id) * {k} as c{k}" for k in range(1, 6)])
    found = q.column_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25])
    assert found == {f"c{k}": [25.0 * k] for k in range(1, 6)}


@pytest.mark.parametrize("small", [50_000, 0])
def test_infinite_values_and_nan(monkeypatch, spark, small):
    monkeypatch.setattr(q, "SMALL_ROWS", small)
    data = [float("inf")] * 10 + [float("-inf")] * 5 + [float("nan")] * 9 + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    values = np.sort([v for v in data if not np.isnan(v)])
    n = len(values)
    probs = [0.0, 50 / (n - 1), 0.5, 1.0]
    expected = [values[0], values[50], np.median(values), values[-1]]
    assert q.column_quantiles(df, {"x": F.col("x")}, probs)["x"] == pytest.approx(expected)
    grouped = q.grouped_quantiles(df.withColumn("g", F.lit("a")), ["g"], "x", probs).first()
    assert (grouped["n"], list(grouped["q"])) == (n, pytest.approx(expected))
