"""Registering queries, and the inputs and roundings both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edaspark.common import column, fields_of, FLOAT_TYPES
from edaspark.sources.scan import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = load(spark, f"{folder}/{name}.parquet")
    return df.selectExpr(*columns) if columns else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Computed doubles to a fixed number of decimals; sums differ in the last bits by order."""
    floats = set(fields_of(df, FLOAT_TYPES))
    return df.select(
        *[(F.round(column(c), digits) + F.lit(0.0)).alias(c) if c in floats else column(c) for c in df.columns]
    )


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


# A table with gaps, duplicates and a column of each null policy.
DIRTY_COLUMNS = (
    "l_orderkey",
    "l_linenumber",
    "case when l_partkey % 2 = 0 then null else l_quantity end as q",
    "case when (l_orderkey + l_linenumber) % 50 = 0 then null else l_tax end as tax",
    "case when (l_orderkey + l_suppkey) % 8 = 0 then null else l_extendedprice end as price",
    "case when l_partkey % 7 = 0 then null else l_returnflag end as flag",
    "l_discount",
)
DIRTY = f"""
with b as (select {', '.join(DIRTY_COLUMNS)} from lineitem),
dirty as (select * from b union all select * from b where l_orderkey % 100 = 0)"""


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "lineitem", *DIRTY_COLUMNS)
    return b.unionAll(b.filter("l_orderkey % 100 = 0"))
