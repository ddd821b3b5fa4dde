"""Tables behind charts of two or three numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import aggregate_once, column, literal, nan_to_null, require_columns, small_frame
from ..operators.quantiles import column_quantiles
from ..operators.summary import correlation_table
from ..sources.roles import NUM, columns_with_role
from .density import kde2d
from .histogram import histogram

JOINT_KINDS = ("scatter", "kde", "hex", "reg")
# Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054
MAX_SIDE = 50
MARKER_PIXELS = 60


def heatmap(df: DataFrame) -> DataFrame:
    """C5. Correlation of every ordered pair of numeric columns; NULL cells are masked."""
    names = columns_with_role(df, NUM)
    if len(names) < 2:
        raise ValueError("A correlation heatmap takes two numeric columns or more.")
    return correlation_table(df, names)


def thinned(df: DataFrame, max_points: int | None, color: str | None = None, key: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """At most so many points of each colour: those with the smallest keyed hashes, which are the same on any layout of the table.

    ``key`` are the columns that tell points apart (all of them, if none is given); rows alike in them are cut in any order. The limit is applied
    in every task before the shuffle. None leaves all points.
    """
    if max_points is None:
        return df
    require_columns(df, key)
    names = list(key) or df.columns
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(column(c).cast("string"), F.lit("")) for c in names]).cast("binary"))
    order = "draw"
    while order in df.columns:
        order += "_"
    drawn = df.withColumn(order, draw)
    if color is None:
        return drawn.orderBy(order).limit(max_points).drop(order)
    rank = order + "_rank"
    within = Window.partitionBy(column(color)).orderBy(order)
    return drawn.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= max_points).drop(order, rank)


def scatter(
    df: DataFrame, axes: Sequence[str], color: str | None = None, hover: bool = True, max_points: int | None = None,
    key: Sequence[str] = (), seed: int = 0,
) -> DataFrame:
    """C6, C7. All points, or ``max_points`` of each colour (see ``thinned``): the axes, the colour, and the other columns for the hover text."""
    wanted = [*axes, *([color] if color else [])]
    require_columns(df, wanted)
    rest = df.columns if hover else []
    return thinned(nan_to_null(df), max_points, color, key, seed).select(*[column(c) for c in dict.fromkeys([*wanted, *rest])])


def traces(df: DataFrame, color: str) -> DataFrame:
    """C6. Points per colour value, one trace each."""
    require_columns(df, [color])
    return df.groupBy(column(color).alias("name")).agg(F.count("*").alias("points"))


def joint(df: DataFrame, x: str, y: str, kind: str = "scatter") -> dict[str, DataFrame]:
    """C8. Centre and marginal tables of a joint plot over the rows where both are present."""
    require_columns(df, [x, y])
    if kind not in JOINT_KINDS:
        raise ValueError(f"No joint plot of kind {kind!r}; there are {', '.join(JOINT_KINDS)}.")
    points = joint_points(df, x, y)
    centre = {"scatter": lambda: points, "kde": lambda: kde2d(points, x, y), "hex": lambda: hexbin(points, x, y)}
    centre["reg"] = lambda: regression(points, x, y)
    return {"centre": centre[kind](), "marginals": histogram(points, list(dict.fromkeys([x, y])))}


def joint_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """C8. The two columns where both are present."""
    require_columns(df, [x, y])
    return nan_to_null(df).select(*[column(c) for c in dict.fromkeys([x, y])]).dropna()


def _pair(df, x, y):
    require_columns(df, [x, y])
    return nan_to_null(df).select(column(x).cast("double").alias("x"), column(y).cast("double").alias("y")).dropna()


def hexbin(df: DataFrame, x: str, y: str) -> DataFrame:
    """C8b. Points per hexagon ``(cx, cy, count)``.

    Cells per side: the mean of both axes' Freedman-Diaconis bin counts, each at most 50.
    Two lattices, one shifted by half a cell; a point goes to the nearer centre under
    ``dx^2 + 3 dy^2`` in cell units.
    """
    pairs = _pair(df, x, y)
    stats = {"n": F.count("*"), "x0": F.min("x"), "x1": F.max("x"), "y0": F.min("y"), "y1": F.max("y")}
    s = aggregate_once(pairs, stats)
    schema = "cx double, cy double, count bigint"
    if not s["n"]:
        return small_frame(df.sparkSession, [], schema)
    quartiles = column_quantiles(pairs, {"x": F.col("x"), "y": F.col("y")}, [0.25, 0.75], rows=s["n"])

    def side(axis):
        width = 2 * (quartiles[axis][1] - quartiles[axis][0]) / s["n"] ** (1 / 3)
        reach = s[f"{axis}1"] - s[f"{axis}0"]
        return min(MAX_SIDE, math.ceil(reach / width) if width else int(math.sqrt(s["n"])))

    nx = max(1, int((side("x") + side("y")) / 2))
    ny = max(1, int(nx / math.sqrt(3)))

    def scale(axis, cells):
        low, high = s[f"{axis}0"], s[f"{axis}1"]
        if low == high:
            low, high = low - 0.5, high + 0.5
        pad = 1e-9 * (high - low)
        return low - pad, (high - low + 2 * pad) / cells

    (x0, sx), (y0, sy) = scale("x", nx), scale("y", ny)
    placed = pairs.selectExpr(f"(x - {literal(x0)}) / {literal(sx)} as u", f"(y - {literal(y0)}) / {literal(sy)} as v")
    near = placed.selectExpr("u", "v", "rint(u) as u1", "rint(v) as v1", "floor(u) + 0.5D as u2", "floor(v) + 0.5D as v2")
    first = "(u - u1) * (u - u1) + 3D * (v - v1) * (v - v1) < (u - u2) * (u - u2) + 3D * (v - v2) * (v - v2)"
    cells = near.selectExpr(f"if({first}, u1, u2) as u", f"if({first}, v1, v2) as v")
    counted = cells.groupBy("u", "v").agg(F.count("*").alias("count"))
    return counted.selectExpr(f"{literal(x0)} + u * {literal(sx)} as cx", f"{literal(y0)} + v * {literal(sy)} as cy", "count")


def regression(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """C8d. Least-squares line with its 95 % band; no line when x is constant."""
    pairs = _pair(df, x, y)
    stats = {"n": F.count("*"), "x0": F.min("x"), "x1": F.max("x"), "mx": F.avg("x"), "my": F.avg("y")}
    stats |= {"sxx": F.var_pop("x"), "syy": F.var_pop("y"), "sxy": F.covar_pop("x", "y")}
    s = aggregate_once(pairs, stats)
    schema = "point int, x double, fit double, lower double, upper double, slope double, intercept double, r2 double"
    if not s["n"] or s["n"] < 3 or s["x0"] == s["x1"]:
        return small_frame(df.sparkSession, [], schema)
    slope = s["sxy"] / s["sxx"]
    intercept = s["my"] - slope * s["mx"]
    r2 = s["sxy"] ** 2 / (s["sxx"] * s["syy"]) if s["syy"] else 1.0
    left = s["n"] * (s["syy"] - slope * s["sxy"])
    error = math.sqrt(max(0.0, left) / (s["n"] - 2))
    rows = []
    for i in range(points):
        at = s["x0"] + (s["x1"] - s["x0"]) * i / (points - 1)
        fit = intercept + slope * at
        half = Z95 * error * math.sqrt(1 / s["n"] + (at - s["mx"]) ** 2 / (s["n"] * s["sxx"]))
        rows.append((i, at, fit, fit - half, fit + half, slope, intercept, r2))
    return small_frame(df.sparkSession, rows, schema)


def bubble_scale(df: DataFrame, size: str) -> tuple[float, float | None]:
    """C13. What to subtract from sizes so that none is negative, and the marker scale."""
    require_columns(df, [size])
    s = aggregate_once(nan_to_null(df), {"lo": F.min(column(size)), "hi": F.max(column(size))})
    if s["lo"] is None:
        return 0.0, None
    shift = s["lo"] if s["lo"] < 0 else 0
    return shift, float(s["hi"] - shift) / MARKER_PIXELS**2


def bubble(
    df: DataFrame, x: str, y: str, size: str, color: str | None = None, max_points: int | None = None, key: Sequence[str] = (), seed: int = 0
) -> DataFrame:
    """C13. All points, or ``max_points`` of each colour, with sizes from zero up, and ``sizeref`` (of all points either way)."""
    require_columns(df, [x, y, size, *([color] if color else [])])
    shift, scale = bubble_scale(df, size)
    df = thinned(nan_to_null(df), max_points, color, key, seed)
    shown = dict.fromkeys([x, y, *([color] if color else []), *[c for c in df.columns if c != size]])
    moved = column(size) - F.lit(shift) if shift else column(size)
    return df.select(*[column(c) for c in shown], column(size).alias("size_raw"), moved.alias("size"), F.lit(scale).alias("sizeref"))
