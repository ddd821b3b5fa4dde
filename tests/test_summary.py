import numpy as np
import pandas as pd
import pytest

from conftest import rows
from edaspark.operators import detail, ranks, summary
from edaspark.operators.outliers import Bounds
from edaspark.plans.report import profile

# Age and income of the worked example whose report is known.
INCOME = """27 70000 29 90000 29 61000 28 60000 42 150000 39 155000 41 160000 38 162000 36 156000 35 130000 37 137000
26 45000 27 48000 28 51000 29 49500 32 53000 40 65000 41 63000 43 64000 39 80000 41 82000 39 58000"""


@pytest.fixture(scope="module")
def income(spark):
    numbers = list(map(int, INCOME.split()))
    data = [(f"n{i}", a, b) for i, (a, b) in enumerate(zip(numbers[::2], numbers[1::2]))]
    return spark.createDataFrame(data, "Name string, Age tinyint, `Income($)` int")


def test_known_report(income):
    report = summary.Report(income)
    assert [tuple(np.round(r[2:], 6)) for r in rows(report.summary())] == [
        (22, 34.818182, 5.90106, 26, 29, 36.5, 39.75, 43),
        (22, 90431.818182, 43505.964412, 45000, 58500, 67500, 135250, 162000),
    ]
    assert round(report.correlation_facts["Age", "Income($)"], 6) == 0.496856
    assert rows(report.scalars()) == [(22, 3, 0, 0, "Name", 0.0)]
    assert rows(report.insights()) == []
    assert rows(report.overview())[2] == (2, "Income($)", "int", 22, 3)
    found = {b.column: (b.lower, b.upper) for b in Bounds.fit(income).bounds}
    assert found == {"Age": (12.875, 55.875), "Income($)": (-56625, 250375)}


def test_shares_on_the_limits(spark):
    data = [(float(i) if i >= 80 else None, "x" if i >= 40 else None, int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(data, "salary double, education string, purchased int")
    texts = [r[2] for r in rows(summary.Report(df).insights())]
    assert texts[:2] == ["Column 'salary' has 10.00% missing values", "Column 'education' has 5.00% missing values"]
    quarters = rows(summary.describe_numeric(df, ["purchased"]))[0]
    assert quarters[2:] == (800, 0.25, pytest.approx(0.433284, abs=1e-6), 0, 0, 0, 0.25, 1)


def test_strong_correlation_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "a double, b double")
    assert [r[2] for r in rows(summary.Report(df).insights())] == [
        "Strong correlation between 'b' and 'a'",
        "Dataset contains 1 duplicate rows",
    ]


def test_correlation_with_gaps_like_pandas(spark):
    random = np.random.default_rng(1)
    pdf = pd.DataFrame(random.normal(size=(300, 4)), columns=list("abcd"))
    pdf["b"] = pdf["b"] + pdf["a"] * 2 + 1e6
    pdf["k"] = 0.1
    pdf = pdf.mask(random.random(pdf.shape) < 0.2)
    found = summary.correlations(spark.createDataFrame(pdf))
    expected = pdf.corr()
    for (a, b), value in found.items():
        if "k" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_constant_only_where_both_are_present(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (5.0, None)], "a double, b double")
    assert summary.correlations(df)["a", "b"] is None
    assert summary.correlations(df)["a", "a"] == 1.0


def test_booleans_and_tile_order(spark):
    df = spark.range(50).selectExpr("id % 2 = 0 as flag", *[f"(id * {k}) % 17 as c{k}" for k in range(1, 11)])
    found, expected = summary.correlations(df), df.toPandas().astype(float).corr()
    assert all(v == pytest.approx(expected.loc[a, b], abs=1e-9) for (a, b), v in found.items())
    assert list(found)[0] == ("flag", "flag")


def test_names_with_dots_spaces_and_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, 2, 3, 4.0), (2, 3, 5, None)], ["a.b", "User ID", "Age", "age"])
        assert [r[1] for r in rows(summary.describe_numeric(df))] == ["a.b", "User ID", "Age", "age"]
        assert rows(summary.Report(df).scalars())[0][4] == "age"
        assert set(profile(df, "detailed")) >= {"variables", "alerts", "spearman"}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    report = summary.Report(df)
    assert rows(report.missing()) == [(0, "x", 0, None), (1, "s", 0, None)]
    assert rows(report.insights()) == []
    assert rows(report.summary())[0][2] == 0


def test_describe_without_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert rows(summary.describe(df)) == [(0, "s", 4, 2, "a", 2)]


def test_times_before_1970(spark):
    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.5' as t union all select timestamp_ntz'1969-12-31 23:59:58'")
    row = summary.describe_time(df).first()
    assert (str(row["mean"]), str(row["min"])) == ("1969-12-31 23:59:58.750000", "1969-12-31 23:59:58")


def test_modes_of_report(income):
    assert set(profile(income)) == {"scalars", "summary", "missing", "correlation", "insights"}
    with pytest.raises(ValueError, match="mode must be 'basic' or 'detailed'"):
        profile(income, "other")


def test_constant_column_in_detail(spark):
    df = spark.createDataFrame([(2.0, "x")] * 4, "c double, s string")
    row = detail.numeric_detail(df).first()
    assert (row["variance"], row["mad"], row["skewness"]) == (0.0, 0.0, None)
    found = {(r[0], r[1]) for r in rows(detail.Detail(df).alerts())}
    assert found == {("c", "constant"), ("s", "constant"), (None, "duplicates")}


def test_nested_columns_are_refused(spark):
    with pytest.raises(ValueError, match="Nested columns are not supported here: v"):
        detail.Detail(spark.createDataFrame([(1, [1.0])], "i int, v array<double>"))


@pytest.mark.parametrize("broadcast,slice_rows", [(100_000, 1_000_000), (10, 40)])
def test_rank_correlation_like_pandas(monkeypatch, spark, broadcast, slice_rows):
    from edaspark import common

    monkeypatch.setattr(ranks, "BROADCAST_RANKS", broadcast)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(ranks, "SLICE_ROWS", slice_rows)
    random = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": random.normal(size=400).round(2), "b": np.where(random.random(400) < 0.4, 0.0, random.pareto(1, 400))})
    pdf["c"] = pdf["a"] ** 3 + random.normal(size=400)
    found = {r[:2]: r[2] for r in rows(ranks.spearman(spark.createDataFrame(pdf)))}
    expected = pdf.corr(method="spearman")
    assert all(v == pytest.approx(expected.loc[k], abs=1e-9) for k, v in found.items())
    ranked = {r[0]: r[2] for r in rows(ranks.average_ranks(spark.createDataFrame(pdf), "b", slice_rows))}
    assert ranked == dict(zip(pdf["b"], pdf["b"].rank()))


def test_top_values_limit_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("string(id % 97) as s", "id % 13 as n")
    plan = detail.common_values(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_wide_table_like_pandas(spark):
    random = np.random.default_rng(6)
    pdf = pd.DataFrame(random.normal(size=(200, 40)) + 1e5, columns=[f"c.{i}" for i in range(40)])
    pdf["c.1"] = pdf["c.0"] * 2
    pdf["c.3"] = 7.0
    pdf["c.5"] = pdf["c.5"].mask(random.random(200) < 0.3)
    found, expected = summary.correlations(spark.createDataFrame(pdf)), pdf.corr()
    assert len(found) == 1600 and list(found)[:2] == [("c.0", "c.0"), ("c.1", "c.0")]
    for (a, b), value in found.items():
        if "c.3" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[a, b], abs=1e-8)


def test_report_of_a_wide_table(spark):
    df = spark.range(300).selectExpr(*[f"if((id + {k}) % 50 = 0, null, (id * {k}) % 101 + 0.5D) as c{k}" for k in range(1, 71)])
    report = detail.Detail(df)
    assert report.variables().count() == 70
    assert report.scalars().first()["total_missing"] == 420
