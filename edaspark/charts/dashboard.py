"""Every column's panel in one table, numeric columns first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import small_frame
from ..sources.roles import CAT, NUM, columns_with_role
from .categories import bars
from .density import CURVE_POINTS, curves, scaled
from .facts import COLUMN, column_group_facts, melted
from .histogram import column_bin_counts, column_bins

PANELS_PER_ROW = 3


def dashboard(df: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """``(panel, grid_row, grid_col, column, role, series, position, label, x, y)``."""
    numeric, categories = columns_with_role(df, NUM, overrides), columns_with_role(df, CAT, overrides)
    names = numeric + categories
    if not names:
        raise ValueError("No columns available for summary dashboard.")
    none = F.lit(None)
    parts = []
    if numeric:
        long = melted(df, numeric)
        facts = column_group_facts(df, numeric)
        sized = column_bins(df, facts)
        counts = column_bin_counts(df, sized)
        curve = scaled(curves(long, [COLUMN], facts, CURVE_POINTS), [COLUMN], sized)
        parts.append(_series(counts, "histogram", "bin", none, "left", "count"))
        parts.append(_series(curve, "kde", "point", none, "x", "y"))
    if categories:
        parts.append(_series(bars(df, categories), "bar", "rank", F.col("value"), None, "n"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    places = [
        (i, i // PANELS_PER_ROW, i % PANELS_PER_ROW, c, NUM if c in numeric else CAT) for i, c in enumerate(names)
    ]
    panels = small_frame(
        df.sparkSession, places, "panel int, grid_row int, grid_col int, column string, role string"
    )
    return F.broadcast(panels).join(both, COLUMN).select(
        "panel", "grid_row", "grid_col", "column", "role", "series", "position", "label", "x", "y"
    )


def _series(frame, series, position, label, x, y):
    return frame.select(
        COLUMN,
        F.lit(series).alias("series"),
        F.col(position).cast("bigint").alias("position"),
        label.cast("string").alias("label"),
        (F.lit(None) if x is None else F.col(x)).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    )
