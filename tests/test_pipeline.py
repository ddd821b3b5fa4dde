import pytest

from catalog.registry import dirty
from conftest import rows
from edaspark.operators.nulls import NullPlan
from edaspark.operators.outliers import Bounds
from edaspark.plans import pipeline, sinks


def test_known_plan_of_the_dirty_table(spark, folder):
    df = dirty(spark, folder)
    plan = NullPlan.fit(df)
    assert [(s.column, s.null_count, s.rows_before, s.action) for s in plan.steps] == [
        ("q", 2999, 6057, "drop_column"),
        ("tax", 139, 6057, "drop_rows"),
        ("price", 764, 5918, "fill_median"),
        ("flag", 892, 5918, "fill_mode"),
    ]
    assert plan.steps[2].fill_number == pytest.approx(52919.44) and plan.steps[3].fill_text == "N"


def test_pipeline(spark, folder):
    result = pipeline.run(dirty(spark, folder), narrowing=True)
    assert rows(result.stages) == [("loaded", 6057, 7), ("cleaned", 5861, 6)]
    assert result.clean.count() == 5861
    assert dict(result.clean.dtypes)["l_discount"] == "float"
    assert ("duplicates", None, "57") in rows(result.issues)
    assert dict(rows(result.iqr_outliers))["price"] == 0
    assert result.report["scalars"].first()["rows"] == 5861
    fence = {b.column: b for b in Bounds.fit(pipeline.tidy(dirty(spark, folder)).frame).bounds}["price"]
    assert (fence.lower, fence.upper) == pytest.approx((-38837.345, 145321.575))


def test_pipeline_on_a_file(spark, tmp_path):
    lines = ["Name,Age,Income($),joined"] + [f" n{i} ,{20 + i % 30},{1000 + i},2020-01-{i % 28 + 1:02d}" for i in range(60)]
    path = tmp_path / "people.csv"
    path.write_text("\n".join(lines + [lines[-1]]))
    result = pipeline.run_path(spark, str(path))
    assert rows(result.stages) == [("loaded", 61, 4), ("cleaned", 60, 4)]
    assert dict(result.clean.dtypes) == {"Name": "string", "Age": "float", "Income($)": "float", "joined": "timestamp_ntz"}
    wide = pipeline.run_path(spark, str(path), narrowing=False)
    assert dict(wide.clean.dtypes) == {"Name": "string", "Age": "double", "Income($)": "double", "joined": "timestamp_ntz"}
    assert result.clean.filter("Name = 'n7'").count() == 1


def test_empty_input(spark):
    with pytest.raises(ValueError, match="Empty dataset."):
        pipeline.run(spark.createDataFrame([], "x double"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    paths = sinks.write_report({"summary": df, "a/b": df}, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["summary", "a%2Fb"]
    one = sinks.write_chart(df, str(tmp_path), "scatter_2d", x="Age", y="Income($)")
    two = sinks.write_chart(df, str(tmp_path), "scatter_2d", x="Age", y="Income($)", color="s")
    assert one != two
    assert rows(spark.read.parquet(sinks.write_chart(df, str(tmp_path), "scatter_2d", x="Age", y="Income($)"))) == [(1, "a")]


def test_stages_as_tables(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    assert sinks.load_stage(spark, "clean_stage") is None
    assert rows(sinks.save_stage(df, "clean_stage")) == [(1, "a")]
    assert rows(sinks.load_stage(spark, "clean_stage")) == [(1, "a")]
    sinks.drop_stage(spark, "clean_stage")
    assert sinks.load_stage(spark, "clean_stage") is None
