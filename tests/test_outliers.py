import numpy as np
import pandas as pd
import pytest

from conftest import rows
from edaspark.operators.outliers import Bounds, cap_outliers, outlier_counts, remove_outliers


def frame(seed=3, n=400):
    random = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "a": np.round(random.standard_t(2, n), 3),
            "b": np.round(random.pareto(1.5, n), 3),
            "c": np.round(random.normal(size=n), 3),
        }
    )


def remaining(pdf, method):
    for c in pdf.columns:
        x = pdf[c]
        if method == "iqr":
            q1, q3 = x.quantile(0.25), x.quantile(0.75)
            pdf = pdf[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        elif x.std() != 0:
            pdf = pdf[((x - x.mean()) / x.std()).abs() <= 3]
    return pdf


@pytest.mark.parametrize("method", ["iqr", "zscore"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_goes_column_by_column(spark, method, seed):
    pdf = frame(seed)
    found = sorted(rows(remove_outliers(spark.createDataFrame(pdf), method)))
    assert found == sorted(map(tuple, remaining(pdf, method).to_numpy()))


@pytest.mark.parametrize("method", ["iqr", "zscore"])
def test_capping_matches_clip(spark, method):
    pdf = frame()
    found = sorted(rows(cap_outliers(spark.createDataFrame(pdf), method)))
    for c in pdf.columns:
        x = pdf[c]
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        low, high = (
            (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
            if method == "iqr"
            else (x.mean() - 3 * x.std(), x.mean() + 3 * x.std())
        )
        pdf[c] = x.clip(low, high)
    assert np.allclose(found, sorted(map(tuple, pdf.to_numpy())), atol=1e-9)


def test_nulls_survive_capping_and_fail_removal(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (2.0,), (100.0,), (None,), (float("nan"),)], "x double")
    assert sorted(r[0] is None for r in rows(cap_outliers(df))) == [False] * 5 + [True] * 2
    assert sorted(r[0] for r in rows(remove_outliers(df))) == [1.0, 2.0, 2.0, 3.0]
    assert rows(outlier_counts(df)) == [("x", 1)]


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(0.1, 1)] * 3, "x double, n int")
    assert rows(outlier_counts(df, "zscore")) == [("x", 0), ("n", 0)]
    assert remove_outliers(df, "zscore").count() == 3
    assert cap_outliers(df, "zscore").count() == 3


def test_single_row(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    assert rows(outlier_counts(df, "zscore")) == [("x", 0)]
    assert remove_outliers(df, "zscore").count() == 0
    assert remove_outliers(df, "iqr").count() == 1


def test_flags_are_capped_unless_excluded_and_booleans_never(spark):
    df = spark.createDataFrame([(0, True)] * 600 + [(1, False)] * 200, "purchased int, b boolean")
    capped = cap_outliers(df).groupBy("purchased", "b").count()
    assert sorted(rows(capped)) == [(0.0, True, 600), (0.625, False, 200)]
    assert cap_outliers(df, exclude=["purchased"]).dtypes[0] == ("purchased", "int")


def test_unknown_method(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    for call in (Bounds.fit, remove_outliers, cap_outliers, outlier_counts):
        with pytest.raises(ValueError, match="'iqr' and 'zscore' are known"):
            call(df, "other")


def test_removal_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(frame()).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = remove_outliers(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert all(f"GreaterThanOrEqual({c}" in pushed and f"LessThanOrEqual({c}" in pushed for c in "abc")


def test_infinite_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("inf"),)], "x double")
    assert rows(outlier_counts(df)) == [("x", 1)]
    assert max(r[0] for r in rows(cap_outliers(df))) == 30.0
    assert rows(outlier_counts(df, "zscore")) == [("x", 0)]
    assert cap_outliers(df, "zscore").count() == 21
