import random
import statistics

import pytest

from conftest import rows
from edaspark.operators import nulls


def model(columns, data, threshold=0.4):
    """The policy column by column on plain lists: the actions and the rows that remain."""
    alive, actions = list(data), {}
    for i, c in enumerate(columns):
        gaps = sum(r[i] is None for r in alive)
        if not gaps:
            continue
        ratio = gaps / len(alive)
        if ratio > threshold:
            actions[c] = ("drop_column", None)
        elif ratio < 0.05:
            actions[c] = ("drop_rows", None)
            alive = [r for r in alive if r[i] is not None]
        else:
            present = [r[i] for r in alive if r[i] is not None]
            if isinstance(present[0], str):
                best = min(set(present), key=lambda v: (-present.count(v), v))
                actions[c] = ("fill_mode", best)
            else:
                actions[c] = ("fill_median", statistics.median(present))
    return actions, len(alive)


def table(seed, n=120):
    source = random.Random(seed)
    shares = [source.choice([0, 0.02, 0.04, 0.05, 0.1, 0.4, 0.41, 0.6]) for _ in range(5)]
    return [
        tuple(
            None if source.random() < s else (source.choice("ab") if i == 2 else float(source.randint(0, 9)))
            for i, s in enumerate(shares)
        )
        for _ in range(n)
    ]


COLUMNS = ["a", "b", "c", "d", "e"]
SCHEMA = "a double, b double, c string, d double, e double"


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("max_patterns", [100_000, 0])
def test_policy_matches_the_walk(spark, seed, max_patterns):
    data = table(seed)
    df = spark.createDataFrame(data, SCHEMA)
    plan = nulls.NullPlan.fit(df, max_patterns=max_patterns)
    actions, left = model(COLUMNS, data)
    found = {s.column: (s.action, s.fill_text if s.action == "fill_mode" else s.fill_number) for s in plan.steps}
    assert found == actions
    out = plan.apply(df)
    assert out.count() == left
    assert out.dropna().count() == left
    assert out.columns == [c for c in COLUMNS if actions.get(c, ("",))[0] != "drop_column"]


def test_walk_over_many_random_tables():
    for seed in range(300):
        data = table(seed, 60)
        patterns = {}
        for r in data:
            flags = tuple(v is None for v in r)
            patterns[flags] = patterns.get(flags, 0) + 1
        decided = nulls._walk_patterns([(list(f), n) for f, n in patterns.items()], COLUMNS, 0.4)
        actions, _ = model(COLUMNS, data)
        assert [c for c, *_ in decided] == list(actions)
        for c, _nulls, _rows, action, _before in decided:
            assert actions[c][0].startswith(action)


def test_ratios_on_the_limits_are_filled(spark):
    data = [(None if i < 2 else 1.0, None if i < 16 else float(i)) for i in range(40)]
    plan = nulls.NullPlan.fit(spark.createDataFrame(data, "five double, forty double"))
    assert [(s.column, s.action, s.ratio) for s in plan.steps] == [
        ("five", "fill_median", 0.05),
        ("forty", "fill_median", 0.4),
    ]


def test_types_of_fills(spark):
    data = [(i if i else None, i % 2 == 0 if i else None, "b" if i % 2 else "a", i if i else None) for i in range(5)]
    df = spark.createDataFrame(data, "whole bigint, flag boolean, tie string, narrow int")
    out = nulls.handle_nulls(df)
    assert dict(out.dtypes) == {"whole": "double", "flag": "boolean", "tie": "string", "narrow": "double"}
    first = out.orderBy("whole").collect()
    assert sorted(r["whole"] for r in first) == [1.0, 2.0, 2.5, 3.0, 4.0]
    filled = [r for r in first if r["whole"] == 2.5][0]
    assert (filled["flag"], filled["narrow"]) == (False, 2.5)  # an integer column with a gap takes the median at any width


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (4.0,), (None,), (5.0,), (9.0,)], "x double")
    plan = nulls.NullPlan.fit(df)
    assert (plan.steps[0].null_count, plan.steps[0].fill_number) == (2, 4.5)
    assert sorted(r[0] for r in rows(plan.apply(df))) == [2.0, 4.0, 4.5, 4.5, 5.0, 9.0]


def test_no_gaps_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert nulls.NullPlan.fit(df).steps == ()
    assert nulls.NullPlan.fit(df.filter("a > 1")).steps == ()


def test_all_null_column_is_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert nulls.handle_nulls(df).columns == ["a"]


@pytest.mark.parametrize("strategy,expected", [("mean", 2.0), ("median", 1.0), ("mode", 1.0)])
def test_whole_column_fills(spark, strategy, expected):
    df = spark.createDataFrame([(1.0, "x"), (1.0, None), (4.0, "x"), (None, "y")], "a double, b string")
    out = rows(nulls.fill_nulls(df, strategy))
    assert (expected, "y") in out
    assert any(r[1] is None for r in out) == (strategy != "mode")


def test_drop_and_unknown_strategy(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y")], "a double, b string")
    assert rows(nulls.fill_nulls(df, "drop")) == [(1.0, "x")]
    with pytest.raises(ValueError, match="Unknown strategy for missing values"):
        nulls.fill_nulls(df, "other")


def test_streaming_rows_take_a_fitted_plan(spark, tmp_path):
    df = spark.createDataFrame([(float(i) if i else None, "a") for i in range(5)], "x double, s string")
    plan = nulls.NullPlan.fit(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = plan.apply(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r[0] for r in rows(spark.table("cleaned"))) == [1.0, 2.0, 2.5, 3.0, 4.0]
