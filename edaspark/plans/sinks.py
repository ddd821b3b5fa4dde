"""Writing reports, chart tables and stages."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """E4. One folder per table of the report; a new run replaces the old."""
    paths = []
    for name, table in tables.items():
        path = f"{folder.rstrip('/')}/{_safe(name)}"
        table.write.mode("overwrite").format(fmt).save(path)
        paths.append(path)
    return paths


def chart_name(chart: str, **params: object) -> str:
    """Chart and all its parameters, so that charts differing in any of them stay apart."""
    parts = [f"{k}={v}" for k, v in sorted(params.items()) if v is not None]
    return _safe("_".join([chart, *parts]))


def write_chart(table: DataFrame, folder: str, chart: str, fmt: str = "parquet", **params: object) -> str:
    """E5. One folder per chart, named by its parameters."""
    path = f"{folder.rstrip('/')}/{chart_name(chart, **params)}"
    table.write.mode("overwrite").format(fmt).save(path)
    return path


def _safe(name: str) -> str:
    """A file name from any text; characters outside the plain ones are spelled by code."""
    return re.sub(r"[^A-Za-z0-9_=-]", lambda m: f"%{ord(m.group()):02X}", name)


def save_stage(df: DataFrame, table: str) -> DataFrame:
    """E6. Keep a stage as a table and go on from there."""
    df.write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def load_stage(spark: SparkSession, table: str) -> DataFrame | None:
    return spark.table(table) if spark.catalog.tableExists(table) else None


def drop_stage(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
