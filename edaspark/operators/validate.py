"""V1, V2, V4: what is wrong with a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import FLOAT_TYPES, aggregate_once, column, fields_of, quoted, small_frame
from .duplicates import duplicate_count


def missing_flag(df: DataFrame, name: str):
    """True where the value is missing: NULL, or NaN in a floating column."""
    c = column(name)
    return c.isNull() | F.isnan(c) if name in fields_of(df, FLOAT_TYPES) else c.isNull()


def count_missing(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and missing values of every column, in one pass."""
    floats = set(fields_of(df, FLOAT_TYPES))
    exprs = {None: "count(*)"}
    for c in df.columns:
        gap = f"{quoted(c)} is null"
        exprs["c", c] = f"count_if({gap} or isnan({quoted(c)}))" if c in floats else f"count_if({gap})"
    found = aggregate_once(df, exprs)
    return found[None], {c: found["c", c] for c in df.columns}


def null_counts(df: DataFrame) -> DataFrame:
    """V1. Missing values per column, only columns that have some."""
    _, counts = count_missing(df)
    rows = [(i, c, n) for i, (c, n) in enumerate(counts.items()) if n > 0]
    return small_frame(df.sparkSession, rows, "ordinal int, column string, nulls bigint")


def column_types(df: DataFrame) -> DataFrame:
    """V2. Type of every column."""
    rows = [(i, c, t) for i, (c, t) in enumerate(df.dtypes)]
    return small_frame(df.sparkSession, rows, "ordinal int, column string, type string")


def issues(df: DataFrame) -> DataFrame:
    """V4. Missing values, types and duplicates as one long table."""
    return issue_table(df, count_missing(df)[1])


def issue_table(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """V4 where the missing values are counted already."""
    rows = [("missing_values", c, str(n)) for c, n in counts.items() if n > 0]
    rows += [("data_types", c, t) for c, t in df.dtypes]
    rows += [("duplicates", None, str(duplicate_count(df)))]
    return small_frame(df.sparkSession, rows, "check string, column string, value string")
