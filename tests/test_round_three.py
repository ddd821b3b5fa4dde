import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edaspark.charts import categories, pairs
from edaspark.operators import detail, duplicates, frequencies, summary
from edaspark.plans import pipeline, reuse
from edaspark.plans.report import profile


def jobs_of(spark, group, act):
    spark.sparkContext.setJobGroup(group, group)
    out = act()
    time.sleep(0.2)
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("none", "none")
    return n, out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Repeated rows beyond the broadcast limit


def test_hot_copies_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BROADCAST_HASHES", 1)
    hot = spark.range(1_000_000).select(F.lit("same").alias("a"), F.lit(1).alias("b"))
    more = spark.range(3000).select(F.concat(F.lit("r"), (F.col("id") % 1000).cast("string")).alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    alone = spark.range(50).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("a"), F.lit(None).cast("int").alias("b"))
    df = hot.unionAll(more).unionAll(alone)
    want = df.distinct().count()
    assert duplicates.duplicate_count(df) == df.count() - want
    kept = duplicates.remove_duplicates(df)
    assert kept.count() == want
    assert duplicates.top_duplicates(df, 1).first()["copies"] == 1_000_000
    # No join brings all copies to one task: each task combines its own copies before the shuffle.
    plan = plan_of(kept)
    assert "Join" not in plan and plan.count("HashAggregate") >= 2


# Frequent values


def test_long_values_are_not_shuffled_and_ties_are_exact(spark):
    base = "p" * 300
    texts = [base + c for c in "ddccbbaee"] + ["pp", "pp", "a" * 64, "a" * 64 + "b", None, "", ""]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "t string, k int").repartition(3)
    want = sorted({(t, texts.count(t)) for t in texts if t is not None}, key=lambda x: (-x[1], x[0]))
    for k in (1, 2, 3, 4, 5, 20):
        got = sorted(rows(frequencies.top_counts(df, ["t"], k)), key=lambda r: r[1])
        assert [(v, n) for _, _, v, n in got] == want[:k]
        assert rows(categories.bars(df, ["t"], k)) and [r[1] for r in got] == list(range(1, len(got) + 1))
    assert rows(summary.describe_category(df, ["t"])) == [(0, "t", 15, 9, "", 2)]
    counted = plan_of(frequencies.key_counts(df, ["t"]))
    shuffled = [line for line in counted.splitlines() if "Exchange" in line]
    assert shuffled and all("value" not in line for line in shuffled)


def test_frequent_values_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert rows(frequencies.top_counts(empty, ["a", "b"], 3)) == []
    assert rows(summary.describe_category(empty, ["a"])) == [(0, "a", 0, 0, None, None)]
    assert rows(summary.describe_category(spark.createDataFrame([(1.0,)], "b double"))) == []
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "b double")
    assert rows(frequencies.top_counts(zeros, ["b"], 1)) == [("b", 1, "0.0", 2)]


# Limits of points


def test_limited_points(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("c"), F.lit(None).cast("string").alias("draw"))
    some = pairs.scatter(df, ["x", "id"], "c", max_points=9, key=["id"])
    assert sorted(rows(some.groupBy("c").count()), key=str) == sorted([(None, 9), *[(k, 9) for k in range(1, 5)]], key=str)
    assert some.columns == ["x", "id", "c", "draw"]
    again = pairs.scatter(df.repartition(7), ["x", "id"], "c", max_points=9, key=["id"])
    assert {r.id for r in some.collect()} == {r.id for r in again.collect()}
    other = pairs.scatter(df, ["x", "id"], "c", max_points=9, key=["id"], seed=1)
    assert {r.id for r in other.collect()} != {r.id for r in some.collect()}
    assert pairs.scatter(df, ["x", "id"], max_points=20).count() == 20
    assert pairs.scatter(df, ["x", "id"], "c").count() == pairs.scatter(df, ["x", "id"], "c", max_points=10**6).count() == 500
    assert pairs.bubble(df, "x", "id", "x", "c", max_points=3).count() == 15
    assert pairs.scatter(df, ["x"], max_points=0).count() == 0
    with pytest.raises(ValueError, match="'nope' not found"):
        pairs.scatter(df, ["x"], max_points=3, key=["nope"])


# Sketches of distinct values


def test_approximate_variables(spark):
    n = 30_000
    df = spark.range(n).select(
        "id", (F.col("id") % 1000).alias("k"), F.lit("c").alias("same"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 2).alias("gaps"), (F.col("id") / 7).alias("part"),
    )
    exact = {r["column"]: r for r in detail.Detail(df).variables().collect()}
    near = {r["column"]: r for r in detail.Detail(df).variables(approximate=True).collect()}
    for c, r in exact.items():
        assert abs(near[c]["distinct"] - r["distinct"]) <= 0.06 * r["distinct"], c
        assert near[c]["unique"] is None
        for k in ("ordinal", "kind", "n", "missing", "missing_pct", "constant"):
            assert near[c][k] == r[k], (c, k)
    halves = [detail.distinct_sketches(df.filter(f"id % 3 {op} 0")) for op in ("=", "<>")]
    merged = dict(rows(detail.distinct_estimates(detail.merged_sketches(halves[0].unionAll(halves[1]))).select("column", "distinct")))
    whole = dict(rows(detail.distinct_estimates(detail.distinct_sketches(df)).select("column", "distinct")))
    assert all(abs(merged[c] - whole[c]) <= 0.02 * whole[c] for c in whole)
    plan = plan_of(detail.distinct_sketches(df))
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan  # sketches alone are moved


# Stages without a job of their own


def test_stage_counts_cost_no_job(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else None, float(k % 5)) for k in range(40)] * 2, "k long, t string, v double")
    result = pipeline.run(df)
    n, stages = jobs_of(spark, "stages", lambda: result.stages)
    assert n == 0
    assert rows(stages) == [("loaded", 80, 3), ("cleaned", result.clean.count(), len(result.clean.columns))]
    cold, fresh = jobs_of(spark, "run", lambda: pipeline.run(df))
    assert "_facts" not in vars(fresh) and "report" not in vars(fresh)
    assert jobs_of(spark, "report", lambda: fresh.report)[0] > 0
    assert jobs_of(spark, "report2", lambda: fresh.report)[0] == 0


# Reuse of stages


def files_read(df):
    return set(df.inputFiles())


def test_stage_store(spark, tmp_path):
    raw, made = str(tmp_path / "raw"), []
    spark.range(100).selectExpr("id", "id % 3 as c").write.parquet(raw)
    store = reuse.StageStore(spark, str(tmp_path / "stages"))

    def clean(df):
        made.append(1)
        return df.filter("c = 1")

    def read():
        return spark.read.parquet(raw)

    one = store.get(read(), "clean", clean)
    two = store.get(read(), "clean", clean)
    assert len(made) == 1 and sorted(rows(one)) == sorted(rows(two))
    bars = categories.bars(two.withColumn("c", F.col("c").cast("string")), ["c"])
    assert rows(bars) == [("c", 1, "1", 33)] and all("stages" in f for f in files_read(two))
    store.get(read().filter("id > 5"), "clean", clean)
    store.get(read(), "clean", clean, {"threshold": 0.5})
    assert len(made) == 3
    spark.range(100, 110).selectExpr("id", "id % 3 as c").write.mode("append").parquet(raw)
    assert store.get(read(), "clean", clean).count() == 37 and len(made) == 4
    spark.range(7).selectExpr("id", "id % 3 as c").write.mode("overwrite").parquet(raw)
    assert store.get(read(), "clean", clean).count() == 2 and len(made) == 5
    store.drop(read(), "clean")
    store.get(read(), "clean", clean)
    assert len(made) == 6


def test_half_written_stage_is_made_again(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "raw"))
    store, df = reuse.StageStore(spark, str(tmp_path / "stages")), spark.read.parquet(str(tmp_path / "raw"))
    path = store.path(df, "s")
    spark.range(3).write.parquet(path)
    (tmp_path / "stages" / path.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert store.get(df, "s", lambda d: d).count() == 10


def test_pipeline_through_the_store(spark, tmp_path):
    spark.range(50).selectExpr("id", "if(id % 9 = 0, null, id % 4) as c").write.parquet(str(tmp_path / "raw"))
    store = reuse.StageStore(spark, str(tmp_path / "stages"))
    df = spark.read.parquet(str(tmp_path / "raw"))
    first = store.get(df, "clean", pipeline.clean)
    n, second = jobs_of(spark, "again", lambda: store.get(spark.read.parquet(str(tmp_path / "raw")), "clean", pipeline.clean))
    assert n <= 2 and second.schema == first.schema and sorted(rows(second), key=str) == sorted(rows(first), key=str)
    assert profile(second)["scalars"].count() == 1
