"""Outliers of numeric columns by quartile fences or z-scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import aggregate_once, as_double, column, literal, nan_to_null, numeric_columns, quoted, small_frame
from .moments import Facts, column_facts
from .quantiles import column_quantiles

IQR, ZSCORE = "iqr", "zscore"
FENCE = 1.5
Z_LIMIT = 3


def _check(method: str) -> None:
    if method not in (IQR, ZSCORE):
        raise ValueError(f"Unknown outlier method {method!r}: '{IQR}' and '{ZSCORE}' are known.")


@dataclass(frozen=True)
class Bound:
    """What is known of one column; ``lower``/``upper`` are None where nothing can be an outlier."""

    column: str
    n: int
    q1: float | None = None
    q3: float | None = None
    mean: float | None = None
    std: float | None = None
    lower: float | None = None
    upper: float | None = None


@dataclass(frozen=True)
class Bounds:
    """Fitted fences. Capping and counting with them are lazy plans over literals."""

    method: str
    bounds: tuple[Bound, ...]

    @classmethod
    def fit(
        cls, df: DataFrame, method: str = IQR, exclude: Sequence[str] = (), facts: Facts | None = None
    ) -> Bounds:
        """``facts`` spares a pass where the table's moments are known already."""
        _check(method)
        df = nan_to_null(df)
        names = [c for c in numeric_columns(df) if c not in exclude]
        return cls(method, tuple(_fit(df, names, method, facts)))

    def cap(self, df: DataFrame) -> DataFrame:
        """O4. Values beyond a fence move to it; nulls stay null; capped columns are double."""
        df = nan_to_null(df)
        found = {b.column: b for b in self.bounds}

        def capped(name):
            b, c = found.get(name), quoted(name)
            if b is None:
                return c
            if b.lower is None:
                return f"double({c}) as {c}"
            low, high = literal(b.lower), literal(b.upper)
            return f"case when {c} < {low} then {low} when {c} > {high} then {high} else double({c}) end as {c}"

        return df.selectExpr(*[capped(c) for c in df.columns])

    def outside(self, b: Bound):
        """SQL condition for an outlier; null for a missing value, None where there can be none."""
        if b.lower is None:
            return None
        c = f"double({quoted(b.column)})"
        if self.method == IQR:
            return f"{c} < {literal(b.lower)} or {c} > {literal(b.upper)}"
        return f"abs(({c} - {literal(b.mean)}) / {literal(b.std)}) > {Z_LIMIT}"

    def counts(self, df: DataFrame) -> dict[str, int]:
        """O1, O2. Outliers of every numeric column, zeros included, in one pass."""
        return count_outliers(df, [self])[0]

    def table(self, df: DataFrame) -> DataFrame:
        """O5. Fences, the statistics behind them and the number of outliers."""
        counts = self.counts(df)
        rows = [
            (b.column, self.method, b.q1, b.q3, b.mean, b.std, b.lower, b.upper, counts[b.column]) for b in self.bounds
        ]
        schema = (
            "column string, method string, q1 double, q3 double, mean double, std double, "
            "lower double, upper double, n_outliers bigint"
        )
        return small_frame(df.sparkSession, rows, schema)


def count_outliers(df: DataFrame, fitted: Sequence[Bounds]) -> list[dict[str, int]]:
    """Outliers per column under several fits, all in one pass."""
    conditions = {(i, b.column): f.outside(b) for i, f in enumerate(fitted) for b in f.bounds}
    found = aggregate_once(nan_to_null(df), {k: f"count_if({x})" for k, x in conditions.items() if x is not None})
    return [{b.column: found.get((i, b.column), 0) for b in f.bounds} for i, f in enumerate(fitted)]


def _fit(df: DataFrame, names: Sequence[str], method: str, facts: Facts | None = None) -> list[Bound]:
    facts = facts or column_facts(df, names, [0.25, 0.75] if method == IQR else ())
    quartiles: Mapping[str, list] = {}
    if method == IQR:
        quartiles = column_quantiles(df, {c: column(c) for c in names}, [0.25, 0.75], facts=facts)
    out = []
    for c in names:
        m = facts.moments[c]
        std = 0.0 if m.constant and m.n > 1 else m.std  # however the mean of a constant was rounded
        q1 = q3 = lower = upper = None
        if method == IQR and m.n:
            q1, q3 = quartiles[c]
            lower, upper = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        if method == ZSCORE and std:
            lower, upper = m.mean - Z_LIMIT * std, m.mean + Z_LIMIT * std
        if lower is not None and (math.isnan(lower) or math.isnan(upper)):
            lower = upper = None  # infinite values leave no fence to compare with
        out.append(Bound(c, m.n, q1, q3, m.mean, std, lower, upper))
    return out


def outlier_counts(df: DataFrame, method: str = IQR) -> DataFrame:
    """O1, O2. ``(column, outliers)`` for every numeric column."""
    counts = Bounds.fit(df, method).counts(df)
    return small_frame(df.sparkSession, list(counts.items()), "column string, outliers bigint")


def cap_outliers(df: DataFrame, method: str = IQR, exclude: Sequence[str] = ()) -> DataFrame:
    """O4, P7. Fit fences and cap at them."""
    return Bounds.fit(df, method, exclude).cap(df)


def remove_outliers(
    df: DataFrame, method: str = IQR, exclude: Sequence[str] = (), at_once: bool = False
) -> DataFrame:
    """O3. Drop rows outside the fences, column after column.

    Fences of a column come from the rows that earlier columns left, so each column is a
    fit of its own; the result is still one scan with one combined filter. Rows with a
    missing value are dropped. ``at_once`` (P9) judges all columns on the whole table
    instead, keeps missing values, and takes z-scores by the population deviation.
    """
    _check(method)
    names = [c for c in numeric_columns(df) if c not in exclude]
    if at_once:
        return _remove_at_once(nan_to_null(df), names, method)
    for name in names:
        b = _fit(nan_to_null(df), [name], method)[0]
        c = as_double(name)
        if method == IQR:
            df = df.filter(c.between(b.lower, b.upper)) if b.lower is not None else df.filter(F.lit(False))
        elif b.std is None:
            df = df.filter(F.lit(False))
        elif b.std > 0:
            df = df.filter(F.abs((c - b.mean) / b.std) <= Z_LIMIT)
    return df


def _remove_at_once(df, names, method):
    fitted = Bounds(method, tuple(_fit(df, names, method)))
    keep = F.lit(True)
    for b in fitted.bounds:
        if b.lower is None:
            continue
        if method == IQR:
            beyond = F.expr(fitted.outside(b))
        else:
            spread = b.std * ((b.n - 1) / b.n) ** 0.5
            beyond = F.abs((as_double(b.column) - b.mean) / spread) >= Z_LIMIT
        keep = keep & ~F.coalesce(beyond, F.lit(False))
    return df.filter(keep)
