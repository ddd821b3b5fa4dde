import numpy as np
import pandas as pd
import pytest

from conftest import rows
from edaspark.charts import categories, dashboard, density, histogram, missing, pairs


def sample(n=900, seed=4):
    random = np.random.default_rng(seed)
    x = random.gamma(2.0, 3.0, n)
    return pd.DataFrame({"x": x, "y": 0.5 * x + random.normal(size=n), "k": random.integers(0, 30, n), "g": random.choice(list("aab"), n)})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sample()).cache()


@pytest.mark.parametrize("name", ["x", "y", "k"])
def test_automatic_bins_like_numpy(frame, name):
    values = sample()[name].to_numpy()
    edges = np.histogram_bin_edges(values, "auto")
    counts, _ = np.histogram(values, edges)
    found = sorted(rows(histogram.histogram(frame, [name])), key=lambda r: r[1])
    assert [r[4] for r in found] == list(counts)
    assert np.allclose([r[2] for r in found], edges[:-1]) and np.allclose([r[3] for r in found], edges[1:])


def test_bins_of_one_value_and_fixed_bins(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "x double")
    assert rows(histogram.histogram(df, ["x"])) == [("x", 0, 2.5, 3.5, 5)]
    df = spark.createDataFrame([(0.0,), (10.0,), (9.0,)], "x double")
    assert [r[4] for r in sorted(rows(histogram.histogram(df, ["x"], 5)), key=lambda r: r[1])] == [1, 0, 0, 0, 2]


def brute(values, grid):
    n, h = len(values), values.std(ddof=1) * len(values) ** -0.2
    z = (grid[:, None] - values[None, :]) / h
    return np.exp(-z * z / 2).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("name", ["x", "k"])
def test_curve_like_brute_force(frame, name):
    values = sample()[name].to_numpy().astype(float)
    found = sorted(rows(density.kde(frame, [name])), key=lambda r: r[1])
    assert len(found) == 200
    assert np.allclose([r[3] for r in found], brute(values, np.array([r[2] for r in found])), rtol=1e-9, atol=0)


def test_far_apart_values_leave_grid_points_untouched(spark):
    values = np.array([0.0] * 300 + [1.0] * 300 + [1e9])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = sorted(rows(density.kde(df, ["x"])), key=lambda r: r[1])
    highest = 1 / (np.std(values, ddof=1) * len(values) ** -0.2 * np.sqrt(2 * np.pi))
    assert np.allclose([r[3] for r in found], brute(values, np.array([r[2] for r in found])), rtol=1e-9, atol=2.1e-16 * highest)


def test_no_curve_for_a_constant(spark):
    assert rows(density.kde(spark.createDataFrame([(1.0,)] * 3, "x double"), ["x"])) == []


def test_plane_density_like_brute_force(frame):
    data = sample()[["x", "y"]].to_numpy()
    inverse = np.linalg.inv(np.cov(data.T) * len(data) ** (-1 / 3))
    norm = len(data) * 2 * np.pi / np.sqrt(np.linalg.det(inverse))
    found = rows(density.kde2d(frame, "x", "y", 12))
    assert len(found) == 144
    for _, _, gx, gy, value in found[::7]:
        d = np.array([gx, gy]) - data
        assert value == pytest.approx(np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inverse, d)).sum() / norm, rel=1e-9)


def test_hexagons_hold_every_point(frame):
    found = rows(pairs.hexbin(frame, "x", "y"))
    assert sum(r[2] for r in found) == 900
    data = sample()
    near = [min((r[0] - a) ** 2 + (r[1] - b) ** 2 for r in found) for a, b in zip(data["x"][:50], data["y"][:50])]
    assert max(near) < np.ptp(data["x"]) ** 2 / 10


def test_regression_like_numpy(frame):
    data = sample()
    slope, intercept = np.polyfit(data["x"], data["y"], 1)
    row = rows(pairs.regression(frame, "x", "y"))[0]
    assert row[5:7] == pytest.approx((slope, intercept))
    assert row[3] < row[2] < row[4]


def test_regression_on_a_constant_axis(spark):
    assert rows(pairs.regression(spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double"), "x", "y")) == []


def test_joint_kinds(frame):
    for kind in pairs.JOINT_KINDS:
        assert set(pairs.joint(frame, "x", "y", kind)) == {"centre", "marginals"}
    with pytest.raises(ValueError, match="No joint plot of kind"):
        pairs.joint(frame, "x", "y", "other")
    with pytest.raises(ValueError, match="Column 'zz' not found in dataset."):
        pairs.joint(frame, "x", "zz")


def test_heatmap_needs_two_columns(spark):
    with pytest.raises(ValueError, match="takes two numeric columns"):
        pairs.heatmap(spark.createDataFrame([(1, "a")], "x int, s string"))


def test_crosstab(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("a", None), (None, 1)], "s string, n int")
    wide = categories.crosstab_wide(df, "s", "n")
    assert wide.columns == ["a", "1", "2"] and rows(wide) == [("a", 1, 1), ("b", 1, 0)]
    assert sorted(rows(categories.crosstab_wide(df, "s", "s"))) == [("a", 3, 0), ("b", 0, 1)]
    shares = {r[:2]: r[3] for r in rows(categories.stacked(df, "s", "n", normalize=True))}
    assert shares == {("a", 1): 0.5, ("a", 2): 0.5, ("b", 1): 1.0}


def test_violin(frame):
    data = sample()
    found = categories.violin(frame, "x", "g")
    for r in rows(found["box"]):
        x = data[data["g"] == r[0]]["x"]
        q1, q2, q3 = x.quantile([0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert r[1:] == pytest.approx((len(x), q1, q2, q3, inside.min(), inside.max()))
    curve = sorted(r[1:] for r in rows(found["density"]) if r[0] == "b")
    values = data[data["g"] == "b"]["x"].to_numpy()
    assert np.allclose([r[2] for r in curve], brute(values, np.array([r[1] for r in curve])), rtol=1e-9, atol=0)


def test_facets_keep_six_categories_and_columns(spark):
    df = spark.range(360).selectExpr("string(id % 8) as c", *[f"double(id % {k + 5}) as v{k}" for k in range(8)])
    long = categories.facet_melt(df, [f"v{k}" for k in range(8)], "c")
    assert long.select("Variable").distinct().count() == 6
    assert sorted(r[0] for r in rows(long.select("c").distinct())) == list("012345")
    grid = categories.facet_grid(df, ["v0", "v1"], "c")
    assert grid["histogram"].groupBy("category", "Variable").agg({"count": "sum"}).select("sum(count)").distinct().collect()[0][0] == 45


def test_bubbles(spark):
    df = spark.createDataFrame([(1, 2.0, -3.0), (2, 3.0, 5.0), (3, 1.0, None)], "x int, y double, s double")
    assert [r["size"] for r in pairs.bubble(df, "x", "y", "s").collect()] == [0.0, 8.0, None]
    assert pairs.bubble_scale(df, "s") == (-3.0, 8.0 / 3600)
    assert pairs.bubble_scale(spark.createDataFrame([(162000,), (45000,)], "s int"), "s") == (0, 45.0)


def test_missing(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else 1.0, "a") for i in range(40)], "id bigint, x double, s string")
    assert missing.missing_matrix(df, ["id"]).columns == ["id", "x"]
    assert missing.missing_matrix(df.select("s"), []) is None
    blocks = rows(missing.missing_blocks(df, "id", 4))
    assert sorted(r[2] for r in blocks) == [10, 10, 10, 10] and sum(r[3] for r in blocks) == 10


def test_dashboard(frame):
    found = dashboard.dashboard(frame).collect()
    assert {(r["panel"], r["column"], r["role"]) for r in found} == {(0, "x", "num"), (1, "y", "num"), (2, "k", "num"), (3, "g", "cat")}
    assert {(r["grid_row"], r["grid_col"]) for r in found if r["column"] == "g"} == {(1, 0)}
    assert sum(r["y"] for r in found if r["series"] == "histogram" and r["column"] == "x") == 900


def test_infinite_values_raise(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (2.0,)], "x double")
    with pytest.raises(ValueError, match="infinite values"):
        histogram.histogram(df, ["x"])


def test_crosstab_labels_that_clash(spark, tmp_path):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "M"), ("y", "m")], "kind string, label string")
    wide = categories.crosstab_wide(df, "kind", "label")
    assert wide.columns == ["kind", "M", "a", "m_"]
    assert sorted(rows(wide)) == [("x", 0, 2, 0), ("y", 1, 0, 1)]
    wide.write.parquet(str(tmp_path / "wide"))
    with pytest.raises(ValueError, match="over 2 values"):
        categories.crosstab_wide(df, "kind", "label", max_columns=2)


@pytest.mark.parametrize("name", ["value", "Value", "variable", "category"])
def test_facets_of_a_category_with_one_of_our_names(spark, name):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], f"{name} string, x double")
    long = categories.facet_melt(df, ["x"], name)
    assert long.columns[0] == name and len({c.lower() for c in long.columns}) == 3
    assert categories.facet_grid(df, ["x"], name)["histogram"].agg({"count": "sum"}).first()[0] == 4


def test_facet_limits_are_arguments(spark):
    df = spark.createDataFrame([(str(i % 9), float(i), float(i)) for i in range(90)], "c string, x double, y double")
    assert len({r[0] for r in rows(categories.facet_melt(df, ["x", "y"], "c"))}) == 6
    more = rows(categories.facet_melt(df, ["x", "y"], "c", max_categories=8, max_columns=1))
    assert len({r[0] for r in more}) == 8 and {r[1] for r in more} == {"x"}


def test_blocks_without_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, None)], "k double, x int")
    assert sorted(rows(missing.missing_blocks(df, "k")), key=str) == [(None, "k", 2, 2, 1.0), (None, "x", 2, 1, 0.5)]
