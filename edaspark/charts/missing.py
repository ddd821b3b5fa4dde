"""C4: where values are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import aggregate_once, column, require_columns
from ..operators.validate import count_missing, missing_flag

BLOCKS = 100


def missing_columns(df: DataFrame) -> list[str]:
    _, counts = count_missing(df)
    return [c for c, n in counts.items() if n > 0]


def missing_matrix(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """C4. Per row 1 (missing) or 0 for each column that has gaps; None when none has."""
    require_columns(df, keys)
    gappy = missing_columns(df)
    if not gappy:
        return None
    return df.select(
        *[column(k) for k in keys if k not in gappy], *[missing_flag(df, c).cast("int").alias(c) for c in gappy]
    )


def missing_blocks(df: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame | None:
    """C4 for tables too long to draw: share missing per column in equal ranges of a numeric key.

    Rows without a key stand in a block of their own, null.
    """
    require_columns(df, [key])
    gappy = missing_columns(df)
    if not gappy:
        return None
    k = column(key).cast("double")
    s = aggregate_once(df, {"lo": F.min(k), "hi": F.max(k)})
    s = {"lo": 0.0, "hi": 0.0} if s["lo"] is None else s
    width = (s["hi"] - s["lo"]) / blocks or 1.0
    block = F.least(F.floor((k - F.lit(s["lo"])) / width), F.lit(blocks - 1))
    block = F.when(k.isNotNull(), block).cast("int").alias("block")
    flags = [F.sum(missing_flag(df, c).cast("bigint")).alias(f"m{i}") for i, c in enumerate(gappy)]
    counted = df.groupBy(block).agg(F.count("*").alias("rows"), *flags)
    long = counted.unpivot(["block", "rows"], [f"m{i}" for i in range(len(gappy))], "slot", "missing")
    label = F.element_at(F.array(*map(F.lit, gappy)), F.substring("slot", 2, 9).cast("int") + 1)
    return long.select("block", label.alias("column"), "rows", "missing", (F.col("missing") / F.col("rows")).alias("share"))
