"""Per-group statistics that bins and bandwidths derive from."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import (
    INTEGER_TYPES,
    column,
    fields_of,
    materialise,
    nan_to_null,
    require_columns,
    small_frame,
)
from ..operators.moments import column_facts
from ..operators.quantiles import column_quantiles, grouped_quantiles

COLUMN, VALUE = "column", "value"
QUARTERS = [0.25, 0.5, 0.75]


def melted(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    name: str = COLUMN,
    value: str = VALUE,
    key_names: Sequence[str] | None = None,
) -> DataFrame:
    """C12c. One row per non-null cell: keys (as ``key_names``), column name, value as double."""
    require_columns(df, [*columns, *keys])
    df = nan_to_null(df)
    cells = df.select(
        *[column(k).alias(f"k{i}") for i, k in enumerate(keys)],
        *[column(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)],
    )
    ids = [F.col(f"k{i}") for i in range(len(keys))]
    long = cells.unpivot(ids, [f"v{i}" for i in range(len(columns))], "slot", VALUE).filter(f"{VALUE} is not null")
    label = F.element_at(F.array(*map(F.lit, columns)), F.substring("slot", 2, 9).cast("int") + 1)
    return long.select(*[i.alias(k) for i, k in zip(ids, key_names or keys)], label.alias(name), F.col(VALUE).alias(value))


def group_facts(long: DataFrame, keys: Sequence[str], value: str = VALUE, quartiles: bool = True) -> DataFrame:
    """Per group: n, lo, hi, std and mean, and unless spared the exact q1, q2, q3."""
    v = column(value)
    spread = long.groupBy(*keys).agg(
        F.count(v).alias("rows"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.stddev_samp(v).alias("std"),
        F.avg(v).alias("mean"),
    )
    spread = materialise(spread.withColumnRenamed("rows", "n"))
    if not quartiles:
        return spread
    total = spread.agg(F.sum("n")).first()[0] or 0
    found = grouped_quantiles(long, keys, value, [0.25, 0.5, 0.75], total).drop("n")
    quarter = [F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)]
    return materialise(spread.join(found, list(keys)).select(*keys, "n", "lo", "hi", "std", "mean", *quarter))


def column_group_facts(df: DataFrame, columns: Sequence[str], quartiles: bool = True) -> DataFrame:
    """The same facts with one group per column, taken without melting the table.

    Infinite values leave no range to draw and raise.
    """
    df = nan_to_null(df)
    facts = column_facts(df, columns, QUARTERS if quartiles else ())
    for c in columns:
        m = facts.moments[c]
        if m.n and (math.isinf(m.low) or math.isinf(m.high)):
            raise ValueError(f"Column '{c}' has infinite values; leave them out before drawing it.")
    values = {c: column(c).cast("double") for c in columns}
    found = column_quantiles(df, values, QUARTERS, facts=facts) if quartiles else {c: [None] * 3 for c in columns}
    rows = []
    for c in columns:
        m = facts.moments[c]
        if m.n:
            rows.append((c, m.n, m.low, m.high, m.std, m.mean, *found[c]))
    schema = f"{COLUMN} string, n bigint, lo double, hi double, std double, mean double, "
    return small_frame(df.sparkSession, rows, schema + "q1 double, q2 double, q3 double")


def integer_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    whole = set(fields_of(df, INTEGER_TYPES))
    return [c for c in columns if c in whole]
