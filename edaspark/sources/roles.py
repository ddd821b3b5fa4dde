"""Roles of columns and the listings built from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..common import FLOAT_TYPES, INTEGER_TYPES, column, small_frame

NUM, CAT = "num", "cat"

# Slots of each chart and what they offer: numeric, categorical or all columns.
CHART_SLOTS = (
    ("scatter_2d", "x", "num"), ("scatter_2d", "y", "num"), ("scatter_2d", "color", "all"),
    ("scatter_3d", "x", "num"), ("scatter_3d", "y", "num"), ("scatter_3d", "z", "num"),
    ("scatter_3d", "color", "all"),
    ("joint_plot", "col1", "num"), ("joint_plot", "col2", "num"),
    ("stacked_bar", "col1", "cat"), ("stacked_bar", "col2", "cat"),
    ("cross_tabulation", "col1", "cat"), ("cross_tabulation", "col2", "cat"),
    ("violin_plot", "num", "num"), ("violin_plot", "cat", "cat"),
    ("facet_grid", "num_cols", "num"), ("facet_grid", "cat", "cat"),
    ("bubble_chart", "x", "all"), ("bubble_chart", "y", "num"),
    ("bubble_chart", "size", "num"), ("bubble_chart", "color", "all"),
)


def roles(df: DataFrame, overrides: Mapping[str, str] | None = None, bool_as_num: bool = False) -> dict[str, str]:
    """S6. Column name to role, in schema order; overrides count for existing columns only."""
    kinds = INTEGER_TYPES + FLOAT_TYPES + (T.DecimalType,) + ((T.BooleanType,) if bool_as_num else ())
    detected = {f.name: NUM if isinstance(f.dataType, kinds) else CAT for f in df.schema.fields}
    return detected | {c: r for c, r in (overrides or {}).items() if c in detected}


def columns_with_role(df: DataFrame, role: str, overrides: Mapping[str, str] | None = None) -> list[str]:
    return [c for c, r in roles(df, overrides).items() if r == role]


def select_role(df: DataFrame, role: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """S7. The columns with one role."""
    return df.select(*[column(c) for c in columns_with_role(df, role, overrides)])


def role_table(df: DataFrame, overrides: Mapping[str, str] | None = None, bool_as_num: bool = False) -> DataFrame:
    rows = [(i, c, r) for i, (c, r) in enumerate(roles(df, overrides, bool_as_num).items())]
    return small_frame(df.sparkSession, rows, "ordinal int, column string, role string")


def listing(df: DataFrame) -> DataFrame:
    """S8. One row per column with its role (booleans as numbers) and the table's shape."""
    n = df.count()
    rows = [(i, c, r, n, len(df.columns)) for i, (c, r) in enumerate(roles(df, bool_as_num=True).items())]
    return small_frame(df.sparkSession, rows, "ordinal int, column string, type string, rows bigint, cols int")


def chart_candidates(df: DataFrame) -> DataFrame:
    """S12. Columns offered to each chart slot; with no categorical column, all of them."""
    found = roles(df, bool_as_num=True)
    offers = {
        "num": [c for c, r in found.items() if r == NUM],
        "cat": [c for c, r in found.items() if r == CAT] or list(found),
        "all": list(found),
    }
    rows = [(chart, slot, c) for chart, slot, kind in CHART_SLOTS for c in offers[kind]]
    return small_frame(df.sparkSession, rows, "chart string, slot string, column string")
