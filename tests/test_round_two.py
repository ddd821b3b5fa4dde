"""Behaviour that once changed silently, or was wrong."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from edaspark import common
from edaspark.charts.missing import missing_matrix
from edaspark.operators import convert, detail, duplicates, nulls, quantiles, ranks, summary
from edaspark.plans.report import profile
from pyspark.sql import functions as F

INF = float("inf")


def test_no_shared_folder_raises(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_discard(spark):
    import os

    path = common.table_path(spark)
    assert common.materialise_table(spark.range(5), path).count() == 5
    plain = path.removeprefix("file:")
    assert os.path.isdir(plain)
    common.discard(spark, path)
    assert not os.path.exists(plain)


@pytest.mark.parametrize("values", [(-INF, -INF, 1.0, 2.0, 3.0), (-INF, 1.0, 2.0, INF, INF), (-INF, INF), (1.0, 2.0, 4.0)])
def test_quantiles_next_to_infinities_either_way(spark, monkeypatch, values):
    probs = [0.0, 0.25, 0.375, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v, "g") for v in values], "x double, k string")
    found = []
    for small in (quantiles.SMALL_ROWS, 0):
        monkeypatch.setattr(quantiles, "SMALL_ROWS", small)
        found.append(quantiles.column_quantiles(df, {"x": F.col("x")}, probs)["x"])
        found.append(quantiles.grouped_quantiles(df, ["k"], "x", probs).first()["q"])
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    assert all(same(a, b) for other in found[1:] for a, b in zip(found[0], other))


def test_few_distinct_values_need_no_narrowing(spark, monkeypatch):
    """A column of few values is read twice, whatever the limit on rows inside its brackets."""
    df = spark.range(2000).selectExpr("double(id % 7) as x", "double(if(id % 100 = 0, id, 3)) as y")
    passes = []
    whole = quantiles.aggregate_once
    monkeypatch.setattr(quantiles, "aggregate_once", lambda *a: passes.append(1) or whole(*a))
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 40)
    found = quantiles.column_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5, 0.75])
    want = df.toPandas().quantile([0.25, 0.5, 0.75])
    assert found == {c: want[c].tolist() for c in df.columns}
    assert len(passes) == 1


def test_narrowing_ends(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 3)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": rng.normal(size=3000), "k": rng.integers(0, 3, 3000)})
    df = spark.createDataFrame(pdf)
    assert quantiles.column_quantiles(df, {"x": F.col("x")}, [0.1, 0.5])["x"] == pytest.approx(pdf.x.quantile([0.1, 0.5]).tolist())
    found = {r["k"]: r["q"] for r in quantiles._sketched(df, ["k"], "x", [0.1, 0.5], bracket_rows=3).collect()}
    for k, of in pdf.groupby("k"):
        assert found[k] == pytest.approx(of.x.quantile([0.1, 0.5]).tolist())


def test_describe_uses_the_sketches_of_its_facts(spark, monkeypatch):
    df = spark.range(500).selectExpr("double(id) as x", "id * 2 as y")
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    sketched = []
    whole = quantiles._sketch_columns
    monkeypatch.setattr(quantiles, "_sketch_columns", lambda *a: sketched.append(1) or whole(*a))
    found = {r["column"]: r["q25"] for r in summary.describe_numeric(df).collect()}
    assert found == {"x": 124.75, "y": 249.5} and not sketched


@pytest.mark.parametrize("kind", ["int", "smallint", "tinyint", "bigint"])
def test_whole_numbers_with_gaps_take_the_median(spark, kind):
    df = spark.createDataFrame([(None,), *[(v,) for v in (1, 1, 1, 5, 6, 7, 8, 9)]], "x int").select(F.col("x").cast(kind))
    step = nulls.NullPlan.fit(df).steps[0]
    assert (step.action, step.fill_number) == ("fill_median", 5.5)


def test_text_as_boolean(spark):
    df = spark.createDataFrame([("0",), ("no",), ("",), (None,)], "s string")
    assert [r[0] for r in rows(convert.cast_columns(df, {"s": "bool"}))] == [True, True, False, None]


@pytest.mark.parametrize(
    "texts",
    [
        ("2020-01-02T03:04:05.5", "2021-11-12T13:14:15.123456"),
        ("2020-01-02T03:04:05Z", "2021-11-12T13:14:15Z"),
        ("2020-01-02T03:04:05+02:00", "2021-11-12T23:14:15-05:30"),
        ("2020-01-02 03:04:05.25+00:00", "2021-11-12 13:14:15.5+01:00"),
        ("01/02/2020 03:04:05 PM", "11/12/2021 12:14:15 AM"),
        ("2020-01-02 03:04 AM", "2021-11-12 12:30 PM"),
    ],
)
def test_date_layouts_as_pandas(spark, texts):
    found = [r[0] for r in rows(convert.detect_dates(spark.createDataFrame([(t,) for t in texts], "s string")))]
    want = pd.to_datetime(list(texts), utc=True, format="mixed").tz_localize(None)
    assert found == [t.to_pydatetime() for t in want]


@pytest.mark.parametrize("texts,layout", [(("01/02/70", "11/12/05"), "%m/%d/%y"), (("01/02/68 10:11", "12/31/69 23:59"), "%m/%d/%y %H:%M")])
def test_two_digit_years_turn_at_69(spark, texts, layout):
    found = [r[0] for r in rows(convert.detect_dates(spark.createDataFrame([(t,) for t in texts], "s string")))]
    assert found == [datetime.strptime(t, layout) for t in texts]


def test_spearman_over_common_rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=80), "c": rng.normal(size=80)})
    pdf["b"] = pdf.a + rng.normal(size=80)
    pdf.loc[rng.random(80) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(80) < 0.3, "b"] = np.nan
    found = {(r["x"], r["y"]): r["r"] for r in ranks.spearman(spark.createDataFrame(pdf)).collect()}
    both = lambda x, y: pdf[[x, y]].dropna().rank().corr().iloc[0, 1]
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        assert found[x, y] == pytest.approx(both(x, y))


def test_correlations_of_gappy_columns_as_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({f"x{k}": rng.normal(1e6 * k, 1 + k, 200) for k in range(6)})
    pdf = pdf.mask(rng.random(pdf.shape) < 0.3)
    pdf["same_where_present"] = np.where(pdf.x0.notna(), 7.0, rng.normal(size=200))
    pdf["hole"] = np.nan
    found, want = summary.correlations(spark.createDataFrame(pdf)), pdf.corr()
    for a in pdf:
        for b in pdf:
            w = want.loc[a, b]
            got = found[a, b]
            assert (got is None and math.isnan(w)) or got == pytest.approx(w, abs=1e-9), (a, b)


def test_correlations_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(60, 7)), columns=list("abcdefg")).mask(rng.random((60, 7)) < 0.2)
    whole = summary.correlations(spark.createDataFrame(pdf))
    monkeypatch.setattr(summary, "BLOCK", 3)
    parts = summary.correlations(spark.createDataFrame(pdf))
    assert parts == {k: pytest.approx(v) for k, v in whole.items()}


def test_extremes_of_long_ids(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 1,), (5,), (None,)], "id long")
    found = [(r["side"], r["rank"], r["exact"], r["n"]) for r in detail.extreme_values(df, k=2).collect()]
    assert sorted(found) == [("largest", 1, str(big + 1), 2), ("largest", 2, str(big), 1), ("smallest", 1, "5", 1), ("smallest", 2, str(big), 1)]


def test_ranks_in_many_slices(spark):
    df = spark.range(1000).selectExpr("double(id % 300) as x")
    found = {r["value"]: r["rank"] for r in ranks.average_ranks(df, "x", slice_rows=7).collect()}
    want = df.toPandas().x
    assert found == dict(zip(want, want.rank()))


def test_modes_in_one_job_a_type(spark):
    df = spark.createDataFrame([(1, 2, "b", 1.0), (1, 3, "a", 2.0), (2, 3, "a", 2.0), (2, None, "b", None)], "x int, y long, s string, d double")
    values = {c: F.col(c) for c in df.columns}
    from edaspark.operators.frequencies import modes

    assert modes(df, values) == {"x": "1", "y": "3", "s": "a", "d": "2.0"}


def test_time_columns_stay_in_the_report(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (3, "2400-01-03")], "id int, day string").withColumn("day", F.to_date("day"))
    found = {r["column"]: r for r in summary.describe(df).collect()}
    assert found["id"]["mean"] == 2.0 and found["id"]["time_min"] is None
    assert (found["day"]["std"], str(found["day"]["time_max"])) == (None, "2400-01-03 00:00:00")
    assert [r["column"] for r in summary.describe(df.select("day")).collect()] == ["day"]


def test_detailed_report_has_sample_and_gaps(spark):
    df = spark.createDataFrame([(k, None if k % 3 else "a") for k in range(9)], "k int, s string")
    found = profile(df, "detailed")
    assert rows(found["sample"])[0] == (0, "a") and found["missing_blocks"].count() > 0
    assert found["missing_matrix"].columns == missing_matrix(df, []).columns == ["s"]


def test_many_repeats_meet_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BROADCAST_HASHES", 1)
    df = spark.range(40).selectExpr("id % 15 as a", "id % 5 as b")
    assert duplicates.duplicate_count(df) == 25
    assert sorted(rows(duplicates.remove_duplicates(df))) == [(k, k % 5) for k in range(15)]
