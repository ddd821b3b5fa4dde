"""C2, C8c, C11b, C12d: Gaussian kernel densities over all values.

Bandwidth ``h = std n^(-1/5)``; ``f(g) = sum(exp(-((g - x) / h)^2 / 2)) / (n h sqrt(2 pi))``.
Every value adds to the grid points within REACH bandwidths. What lies beyond is less than 2.1e-16 of a
kernel's height each, so a density errs by less than that share of the highest one there could be, ``1 / (h sqrt(2 pi))``.
Each task adds its values up on the grid, so only grid points leave it, once per batch of rows and group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import aggregate_once, column, join_group_stats, nan_to_null, require_columns, small_frame, spread
from .facts import COLUMN, VALUE, column_group_facts, melted
from .histogram import column_bins

CURVE_POINTS = 200
VIOLIN_POINTS = 100
REACH = 8.5


def _curve_sums(points: int):
    """(group, v, start, step, h) rows to (group, point, total) of each batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, v, start, step, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            groups, own = np.unique(group, return_inverse=True)
            at, gap = (v - start) / h, step / h
            first = np.maximum(0, np.ceil((at - REACH) / gap)).astype(np.int64)
            last = np.minimum(points - 1, np.floor((at + REACH) / gap)).astype(np.int64)
            sums = np.zeros(len(groups) * points)
            live = np.flatnonzero(first <= last)
            k = 0
            while len(live):
                point = first[live] + k
                x = point * gap[live] - at[live]
                sums += np.bincount(own[live] * points + point, np.exp(-0.5 * x * x), len(sums))
                live = live[point < last[live]]
                k += 1
            some = np.flatnonzero(sums)
            yield pa.record_batch(
                [pa.array(groups[some // points]), pa.array((some % points).astype(np.int32)), pa.array(sums[some])],
                names=["group", "point", "total"],
            )

    return rows


def curves(
    long: DataFrame, keys: Sequence[str], facts: DataFrame, points: int, extend: float = 0.0, value: str = VALUE
) -> DataFrame:
    """``(keys, point, x, density)`` per group; no curve for a constant or single value."""
    keys = list(keys)
    h = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    params = facts.filter("n >= 2 and hi > lo").withColumn("h", h)
    params = params.select(
        *keys,
        "n",
        "h",
        F.xxhash64(*keys).alias("group"),
        (F.col("lo") - extend * F.col("h")).alias("start"),
        ((F.col("hi") - F.col("lo") + 2 * extend * F.col("h")) / (points - 1)).alias("step"),
    )
    rows = facts.agg(F.sum("n")).first()[0]
    values = spread(long.select(*keys, F.col(value).alias("v")), rows or 0)
    placed = join_group_stats(values, params, keys, "n").select("group", "v", "start", "step", "h")
    summed = placed.mapInArrow(_curve_sums(points), "group long, point int, total double")
    summed = summed.groupBy("group", "point").agg(F.sum("total").alias("total"))
    every = params.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    full = every.join(summed, ["group", "point"], "left")
    density = F.coalesce("total", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    x = F.col("start") + F.col("point") * F.col("step")
    return full.select(*keys, "point", x.alias("x"), density.alias("density"))


def kde(df: DataFrame, columns: Sequence[str], points: int = CURVE_POINTS) -> DataFrame:
    """C2. Density curve of each numeric column, also scaled to the histogram's counts (``y``)."""
    require_columns(df, columns)
    long = melted(df, columns)
    facts = column_group_facts(df, columns)
    sized = column_bins(df, facts)
    return scaled(curves(long, [COLUMN], facts, points), [COLUMN], sized)


def scaled(curve: DataFrame, keys: Sequence[str], sized: DataFrame) -> DataFrame:
    """Curve with ``y``, its height over a histogram of counts."""
    area = sized.select(*keys, "n", (F.col("n") * F.col("width")).alias("area"))
    return join_group_stats(curve, area, keys, "n").select(
        *keys, "point", "x", "density", (F.col("density") * F.col("area")).alias("y")
    )


def _plane_sums(points: int, grid_x: tuple, grid_y: tuple, form: tuple):
    """(x, y) rows to (cell, total) of each batch."""

    def reached(v, start, step, reach):
        first = np.maximum(0, np.ceil((v - reach - start) / step)).astype(np.int64)
        last = np.minimum(points - 1, np.floor((v + reach - start) / step)).astype(np.int64)
        return first, last

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            (first_x, last_x), (first_y, last_y) = reached(x, *grid_x), reached(y, *grid_y)
            sums = np.zeros(points * points)
            across = np.arange(points)
            for a in range(0, len(x), 512):
                part = slice(a, a + 512)
                dx = grid_x[0] + across * grid_x[1] - x[part, None]
                dy = grid_y[0] + across * grid_y[1] - y[part, None]
                in_x = (across >= first_x[part, None]) & (across <= last_x[part, None])
                in_y = (across >= first_y[part, None]) & (across <= last_y[part, None])
                i, j = (slice(int(m.any(0).argmax()), points - int(m.any(0)[::-1].argmax())) for m in (in_x, in_y))
                dx, dy = dx[:, i, None], dy[:, None, j]
                kernel = np.exp(-0.5 * (form[0] * dx * dx - 2 * form[1] * dx * dy + form[2] * dy * dy))
                sums.reshape(points, points)[i, j] += kernel.sum(0)
            some = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["cell", "total"])

    return rows


def kde2d(df: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """C8c. Density of a pair on a square grid, covariance scaled by ``n^(-1/3)``."""
    require_columns(df, [x, y])
    pairs = nan_to_null(df).select(column(x).cast("double").alias("x"), column(y).cast("double").alias("y")).dropna()
    stats = {"n": F.count("*"), "sxx": F.var_samp("x"), "syy": F.var_samp("y"), "sxy": F.covar_samp("x", "y")}
    stats |= {"x0": F.min("x"), "x1": F.max("x"), "y0": F.min("y"), "y1": F.max("y")}
    s = aggregate_once(pairs, stats)
    schema = "ix int, iy int, x double, y double, density double"
    if not s["n"] or s["n"] < 2:
        return small_frame(df.sparkSession, [], schema)
    scale = s["n"] ** (-1 / 3)
    sxx, syy, sxy = s["sxx"] * scale, s["syy"] * scale, s["sxy"] * scale
    det = sxx * syy - sxy * sxy
    if det <= 0:
        return small_frame(df.sparkSession, [], schema)
    step_x, step_y = (s["x1"] - s["x0"]) / (points - 1), (s["y1"] - s["y0"]) / (points - 1)
    form = (syy / det, sxy / det, sxx / det)
    grid_x = (s["x0"], step_x, REACH * sxx**0.5)
    grid_y = (s["y0"], step_y, REACH * syy**0.5)
    summed = spread(pairs, s["n"]).mapInArrow(_plane_sums(points, grid_x, grid_y, form), "cell int, total double")
    summed = summed.groupBy("cell").agg(F.sum("total").alias("total"))
    grid = df.sparkSession.range(points * points).select(F.col("id").cast("int").alias("cell"))
    grid = grid.withColumns({"ix": F.expr(f"int(cell div {points})"), "iy": F.col("cell") % points})
    norm = s["n"] * 2 * math.pi * math.sqrt(det)
    return grid.join(summed, "cell", "left").select(
        "ix",
        "iy",
        (F.lit(s["x0"]) + F.col("ix") * step_x).alias("x"),
        (F.lit(s["y0"]) + F.col("iy") * step_y).alias("y"),
        (F.coalesce("total", F.lit(0.0)) / norm).alias("density"),
    )
