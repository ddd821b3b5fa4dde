"""One call for either report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..charts.histogram import histogram
from ..charts.missing import missing_blocks, missing_matrix
from ..common import TIME_TYPES, fields_of, numeric_columns
from ..operators import detail as d
from ..operators.duplicates import top_duplicates
from ..operators.ranks import cramers_v, spearman
from ..operators.summary import Report

DETAIL_BINS = 50


def profile(df: DataFrame, mode: str = "basic") -> dict[str, DataFrame]:
    """The report's tables by name. ``basic``: summary tables and insights; ``detailed``: all of it.

    The detailed one holds the first rows by all columns, and where values are missing by ranges of the first numeric column.
    """
    if mode == "basic":
        return Report(df).basic()
    if mode != "detailed":
        raise ValueError("mode must be 'basic' or 'detailed'")
    report = d.Detail(df)
    numbers, texts = numeric_columns(df), fields_of(df, (T.StringType,))
    flags = fields_of(df, (T.BooleanType,))
    tables = report.basic() | {
        "variables": report.variables(),
        "common_values": d.common_values(df),
        "nullity": d.nullity_correlation(df),
        "duplicate_groups": top_duplicates(df),
        "alerts": report.alerts(),
    }
    if numbers:
        tables |= {
            "numeric_detail": d.numeric_detail(df),
            "histogram": histogram(df, numbers, DETAIL_BINS),
            "extremes": d.extreme_values(df),
            "spearman": spearman(df),
        }
    tables["sample"] = d.sample(df, df.columns)
    blocks = missing_blocks(df, numbers[0]) if numbers else None
    if blocks is not None:
        tables["missing_blocks"] = blocks
    matrix = missing_matrix(df, [])
    if matrix is not None:
        tables["missing_matrix"] = matrix
    if texts:
        tables["text_detail"] = d.text_detail(df)
        tables |= {f"words_{c}": d.word_counts(df, c) for c in texts}
    if fields_of(df, TIME_TYPES):
        tables["time_detail"] = d.time_detail(df)
    if len(texts + flags) > 1:
        tables["cramers_v"] = cramers_v(df, texts + flags)
    return tables
