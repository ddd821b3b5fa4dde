from datetime import datetime

import pytest

from conftest import rows
from edaspark.operators import convert

PADDED = ["\ta ", "\x1c b\x1f", " c　", "\u0085d\n", " e​"]


def test_trim_like_python(spark):
    df = spark.createDataFrame([(t,) for t in PADDED] + [(None,)], "s string")
    assert [r[0] for r in rows(convert.trim_strings(df))] == [t.strip() for t in PADDED] + [None]


DATES = {
    "iso": (["2021-03-04", "2020-12-31"], datetime(2021, 3, 4)),
    "month_first": (["03/04/2021", "12/31/2020"], datetime(2021, 3, 4)),
    "day_first": (["03/04/2021", "31/12/2020"], datetime(2021, 4, 3)),
    "stamped": (["2021-03-04 05:06:07", "2020-12-31 00:00:00"], datetime(2021, 3, 4, 5, 6, 7)),
    "year": (["2021", "2020"], datetime(2021, 1, 1)),
    "long": (["March 4, 2021", "December 31, 2020"], datetime(2021, 3, 4)),
    "fraction": (["2021-03-04 05:06:07.25", "2021-03-04 05:06:07.123456"], datetime(2021, 3, 4, 5, 6, 7, 250000)),
    "with_gap": (["2021-03-04", None], datetime(2021, 3, 4)),
    "impossible": (["2021-02-30", "2021-03-04"], None),
    "mixed": (["2021-03-04", "31/12/2020"], None),
    "digit": (["1", "2"], None),
    "words": (["May", "June"], None),
    "empty": ([None, None], None),
}


@pytest.mark.parametrize("name", DATES)
def test_dates(spark, name):
    texts, first = DATES[name]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    out = convert.detect_dates(df)
    assert out.dtypes == [("d", "string" if first is None else "timestamp_ntz")]
    assert out.first()[0] == (texts[0] if first is None else first)


def test_date_column_whose_first_rows_are_null(spark):
    df = spark.range(5000).selectExpr("if(id < 4990, null, '2020-01-01') as d").coalesce(1)
    assert convert.detect_dates(df).dtypes == [("d", "timestamp_ntz")]


def test_casts_raise_on_bad_values(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    with pytest.raises(Exception, match="Cannot convert column s"):
        convert.cast_columns(df, {"s": "int"}).collect()
    assert rows(convert.cast_columns(df.filter("s = '1'"), {"s": "float64", "absent": "int"})) == [(1.0,)]


def test_narrowing(spark):
    data = [(1, 300, 70_000, 2**40, 0.5, 0.1, 1234567.891), (-128, 5, 1, 1, 2.0, 0.7, 1.0)]
    df = spark.createDataFrame(data, "a bigint, b bigint, c bigint, d bigint, e double, f double, g double")
    assert [t for _, t in convert.narrow(df).dtypes] == ["tinyint", "smallint", "int", "bigint", "float", "float", "double"]


def test_narrowing_keeps_overflow_and_empty(spark):
    df = spark.createDataFrame([(1e300, None), (float("inf"), None)], "x double, y bigint")
    assert convert.narrow(df).dtypes == [("x", "double"), ("y", "bigint")]


def test_convert_types_in_order(spark):
    df = spark.createDataFrame([(" 2020-01-01 ", 7, "5"), ("2020-01-02", 8, "6")], "d string, n bigint, s string")
    out = convert.convert_types(df, {"s": "int64"})
    assert out.dtypes == [("d", "timestamp_ntz"), ("n", "tinyint"), ("s", "tinyint")]
