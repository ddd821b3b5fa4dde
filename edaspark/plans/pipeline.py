"""The whole chain, from a raw table to a clean one and its report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..common import SPREAD_ROWS, discard, materialise_table, nan_to_null, reject_nested, small_frame, table_path
from ..operators.convert import DatePlan, NarrowPlan, cast_columns, trim_strings
from ..operators.duplicates import remove_duplicates
from ..operators.moments import Facts, column_facts
from ..operators.nulls import DROP_THRESHOLD, NullPlan
from ..operators.outliers import IQR, ZSCORE, Bounds, count_outliers
from ..operators.summary import QUARTILES, Report
from ..operators.validate import issue_table
from ..sources.scan import load


@dataclass(frozen=True)
class Tidied:
    """A table with nulls handled, types converted and duplicates removed, written once."""

    frame: DataFrame
    null_plan: NullPlan
    # Rows of the frame, counted while it was written.
    rows: int


def tidy(df: DataFrame, threshold: float = DROP_THRESHOLD, schema: dict[str, str] | None = None) -> Tidied:
    """Null policy, trimming, casts, dates, duplicates. Numbers stay as wide as they came."""
    reject_nested(df)
    df = nan_to_null(df)
    plan = NullPlan.fit(df, threshold)
    if plan.rows == 0:
        raise ValueError("Empty dataset.")
    filled = trim_strings(plan.apply(df))
    if schema:
        filled = cast_columns(filled, schema)
    dated = DatePlan.fit(filled).apply(filled)
    written = Observation()
    if plan.rows <= SPREAD_ROWS:
        whole = materialise_table(remove_duplicates(dated, plan.rows).observe(written, F.count(F.lit(1)).alias("rows")))
        return Tidied(whole, plan, written.get["rows"])
    # Looking for copies reads the table more than once; it is trimmed and dated only here.
    path = table_path(df.sparkSession)
    whole = remove_duplicates(materialise_table(dated, path))
    whole = materialise_table(whole.observe(written, F.count(F.lit(1)).alias("rows")))
    discard(df.sparkSession, path)
    return Tidied(whole, plan, written.get["rows"])


def clean(
    df: DataFrame, threshold: float = DROP_THRESHOLD, exclude: Sequence[str] = (), narrowing: bool = True
) -> DataFrame:
    """E2. The cleaning part alone: tidy, cap at the quartile fences, store in the narrowest types."""
    tidied = tidy(df, threshold).frame
    capped = Bounds.fit(tidied, IQR, exclude).cap(tidied)
    return NarrowPlan.fit(capped).apply(capped) if narrowing else capped


class PipelineResult:
    """The clean table and what is known of it. The table is tidied when the pipeline runs; each part beyond is made when it is asked for.

    The parts share their passes: one for the columns' facts, one for the outlier counts.
    """

    def __init__(self, df: DataFrame, tidied: Tidied, exclude: Sequence[str], narrowing: bool):
        self._raw, self._tidied, self._exclude, self._narrowing = df, tidied, exclude, narrowing

    @cached_property
    def _facts(self) -> Facts:
        return column_facts(self._tidied.frame, probs=QUARTILES)

    @cached_property
    def _fences(self) -> Bounds:
        return Bounds.fit(self._tidied.frame, IQR, self._exclude, self._facts)

    @cached_property
    def _capped(self) -> DataFrame:
        return self._fences.cap(self._tidied.frame)

    @cached_property
    def _outliers(self) -> list[dict[str, int]]:
        scores = Bounds.fit(self._tidied.frame, ZSCORE, self._exclude, self._facts)
        return count_outliers(self._tidied.frame, [self._fences, scores])

    @cached_property
    def clean(self) -> DataFrame:
        return NarrowPlan.fit(self._capped).apply(self._capped) if self._narrowing else self._capped

    @cached_property
    def issues(self) -> DataFrame:
        return issue_table(self._raw, self._tidied.null_plan.missing)

    @cached_property
    def null_plan(self) -> DataFrame:
        return self._tidied.null_plan.table(self._raw)

    @property
    def iqr_outliers(self) -> DataFrame:
        return small_frame(self._raw.sparkSession, list(self._outliers[0].items()), OUTLIER_COUNTS)

    @property
    def zscore_outliers(self) -> DataFrame:
        return small_frame(self._raw.sparkSession, list(self._outliers[1].items()), OUTLIER_COUNTS)

    @cached_property
    def report(self) -> dict[str, DataFrame]:
        return Report(self._capped).basic()

    @property
    def stages(self) -> DataFrame:
        """E3. Rows and columns at load and after cleaning, as counted by the passes that fit and write; no job of its own."""
        stages = [
            ("loaded", self._tidied.null_plan.rows, len(self._raw.columns)),
            ("cleaned", self._tidied.rows, len(self._tidied.frame.columns)),
        ]
        return small_frame(self._raw.sparkSession, stages, "stage string, rows bigint, cols int")


OUTLIER_COUNTS = "column string, outliers bigint"


def run(
    df: DataFrame,
    threshold: float = DROP_THRESHOLD,
    schema: dict[str, str] | None = None,
    exclude: Sequence[str] = (),
    narrowing: bool = True,
) -> PipelineResult:
    """E1. Validate, clean, count and cap outliers, report on the clean table.

    ``narrowing`` stores the clean table in the narrowest types that hold it; the
    statistics before it are all taken in full width.
    """
    return PipelineResult(df, tidy(df, threshold, schema), exclude, narrowing)


def run_path(spark: SparkSession, path: str, **options) -> PipelineResult:
    """E1 on a file or table by name. Text is parsed once and kept as a table."""
    df = load(spark, path)
    columnar = path.rstrip("/").lower().endswith(".parquet") or "/" not in path
    return run(df if columnar else materialise_table(df), **options)
