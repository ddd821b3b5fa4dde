import random
import re
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edaspark.functions.text import DATE_LAYOUTS, parsed_time
from edaspark.operators import convert

FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%d/%m/%Y", "%d/%m/%y %H:%M", "%Y%m%d", "%d %b %Y", "%B %d, %Y", "%m/%d/%Y %I:%M %p", "%Y-%m-%dT%H:%M:%S.%f"]


def slow_plan(df):
    """The first layout under which every value of a column parses, by a parse per layout."""
    found = []
    for c in df.columns:
        n = df.filter(F.col(c).isNotNull()).count()
        exprs = [F.count(parsed_time(F.col(c), s, x)) for s, x in DATE_LAYOUTS]
        fits = df.agg(*exprs).first()
        full = [(c, *DATE_LAYOUTS[k]) for k, m in enumerate(fits) if m == n > 0]
        found += full[:1]
    return tuple(found)


@pytest.mark.parametrize("seed", range(3))
def test_same_layouts_as_by_parsing_all(spark, seed):
    rng = random.Random(seed)
    columns = []
    for k in range(12):
        form = rng.choice(FORMATS)
        span = rng.choice([20, 400, 9000])
        start = datetime(2001, 1, rng.choice([1, 20]))
        values = [(start + timedelta(days=rng.randrange(span), seconds=rng.randrange(86400))).strftime(form) for _ in range(40)]
        for odd in rng.sample([None, "2021-02-30", "31/02/2020", "13/13/2020", "20201301", "x", "0000-01-01", "30 Foo 2020", "1/1/2020"], rng.choice([0, 0, 1, 1])):
            values[rng.randrange(40)] = odd
        columns.append(values)
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"c{k} string" for k in range(12))).coalesce(2)
    assert convert.DatePlan.fit(df).layouts == slow_plan(df)


def test_forms_are_few(spark, monkeypatch):
    texts = [f"{m}/{d}/20{y:02}" for m in range(1, 13) for d in range(1, 29) for y in (1, 30)] + ["some words", "x" * 50, "Ab 3 2020", "May 3", "Jun 4"]
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    forms = {f.form: (f.low, f.high) for f in convert._text_forms(frame, ["v"])["v"]}
    assert set(forms) == {"9/9/9999", "99/9/9999", "9/99/9999", "99/99/9999", "aaaa aaaaa", "Ab 9 9999", "aaa 9", None}
    assert forms["99/99/9999"] == ([10, 10, 2001], [12, 28, 2030]) and forms["aaa 9"] == ([3], [4])
    monkeypatch.setattr(convert, "MOST_FORMS", 7)
    assert convert._text_forms(frame, ["v"]) == {"v": []}


def test_two_scans_and_no_parse_unless_needed(spark, monkeypatch):
    parsed = []
    monkeypatch.setattr(convert, "parsed_time", lambda c, shape, layout: parsed.append(layout) or parsed_time(c, shape, layout))
    days = spark.createDataFrame([("2020-01-05", "28/02/2020", "Jan 3, 2020", "31/01/2020")] * 3, "a string, b string, c string, d string")
    plan = convert.DatePlan.fit(days)
    assert [x for _, _, x in plan.layouts] == ["yyyy-M-d", "d/M/yyyy", "MMM d, yyyy", "d/M/yyyy"]
    assert sorted(parsed) == sorted(["MMM d, yyyy", "MMMM d, yyyy", "d/M/yyyy"])


def test_shapes_hold_independent_numbers():
    # ``TextForm.fits`` looks at the least and greatest numbers only: each number's range must be an interval.
    for shape, layout in DATE_LAYOUTS:
        if layout == "yyyyMMdd":
            continue
        for width in (1, 2):
            for part in re.findall(r"\(0\?\[1-9\]\|1\[0-2\]\)|\(0\?\[1-9\]\|\[12\]\[0-9\]\|3\[01\]\)|\(\[01\]\?\[0-9\]\|2\[0-3\]\)", shape):
                fits = [k for k in range(10**width) if re.fullmatch(part, str(k).zfill(width))]
                assert fits == list(range(fits[0], fits[-1] + 1))


def test_zones_and_long_numbers_need_no_parse(spark, monkeypatch):
    parsed = []
    monkeypatch.setattr(convert, "parsed_time", lambda c, shape, layout: parsed.append(layout) or parsed_time(c, shape, layout))
    texts = [("2020-01-05T10:00:00+02:00", "2020", "2020-01-05T10:00:00Z"), ("2021-11-28T23:59:59-17:30", "99999999999", "2020-02-07 01:02:03+01:00")]
    df = spark.createDataFrame(texts, "a string, b string, c string")
    zoned = "yyyy-M-d['T'][ ]H:mm:ssXXX"
    assert [(c, x) for c, _, x in convert.DatePlan.fit(df).layouts] == [("a", zoned), ("c", zoned)] and not parsed
    wide = spark.createDataFrame([("2020-01-05T10:00:00+02:00",), ("2020-01-05T10:00:00+19:00",)], "a string")
    assert convert.DatePlan.fit(wide).layouts == () and parsed == [zoned]


def test_only_late_days_are_parsed(spark):
    texts = ["2020-01-05", "2020-02-29", None, "2020-10-31"]
    assert convert.DatePlan.fit(spark.createDataFrame([(t,) for t in texts], "v string")).layouts
    assert not convert.DatePlan.fit(spark.createDataFrame([(t,) for t in [*texts, "2021-02-29"]], "v string")).layouts
