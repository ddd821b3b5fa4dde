"""Describe, correlation, missingness, insights and report scalars."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import (
    NUMERIC_TYPES,
    TIME_TYPES,
    aggregate_once,
    column,
    fields_of,
    materialise_table,
    nan_to_null,
    numeric_columns,
    small_frame,
)
from .duplicates import duplicate_count
from .frequencies import key_counts, top_of
from .moments import Facts, column_facts
from .quantiles import column_quantiles

QUARTILES = [0.25, 0.5, 0.75]
STRONG = 0.8
DESCRIBE_SCHEMA = (
    "ordinal int, column string, count bigint, mean double, std double, min double, "
    "q25 double, q50 double, q75 double, max double"
)


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, facts: Facts | None = None
) -> DataFrame:
    """R1. One row per numeric column; quartiles are exact and interpolated."""
    df = nan_to_null(df)
    names = numeric_columns(df) if columns is None else list(columns)
    facts = facts or column_facts(df, names, QUARTILES)
    quartiles = column_quantiles(df, {c: column(c) for c in names}, QUARTILES, facts=facts)
    rows = []
    for i, c in enumerate(names):
        m = facts.moments[c]
        rows.append((i, c, m.n, m.mean, m.std, m.low, *quartiles[c], m.high))
    return small_frame(df.sparkSession, rows, DESCRIBE_SCHEMA)


def micros(c: Column) -> Column:
    """A date or time as microseconds of its wall clock since 1970."""
    return F.unix_micros(c.cast("timestamp"))


def _time_rows(df: DataFrame) -> dict[str, tuple]:
    """Count, then mean, min, quartiles and max in microseconds, of date and time columns.

    Quartiles are taken of distances from the earliest time, which doubles hold exactly over 285 years.
    """
    names = fields_of(df, TIME_TYPES)
    values = {c: micros(column(c)) for c in names}
    exprs = {}
    for c, x in values.items():
        exprs |= {(c, f.__name__): f(x) for f in (F.count, F.min, F.max)}
        exprs[c, "avg"] = F.avg(x.cast("decimal(20,0)"))
    found = aggregate_once(df, exprs)
    since = {c: x - F.lit(found[c, "min"] or 0) for c, x in values.items()}
    quartiles = column_quantiles(df, since, QUARTILES, max((found[c, "count"] for c in names), default=0))

    def whole(x, start=0):
        return None if x is None else start + math.floor(x)

    return {
        c: (
            found[c, "count"], whole(found[c, "avg"]), found[c, "min"],
            *[whole(q, found[c, "min"]) for q in quartiles[c]], found[c, "max"],
        )
        for c in names
    }


TIME_STATS = ("mean", "min", "q25", "q50", "q75", "max")


def describe_time(df: DataFrame) -> DataFrame:
    """R1 for date and time columns: the same statistics as times, no deviation."""
    rows = [(i, c, *stats) for i, (c, stats) in enumerate(_time_rows(df).items())]
    schema = "ordinal int, column string, count bigint, " + ", ".join(f"{s} bigint" for s in TIME_STATS)
    frame = small_frame(df.sparkSession, rows, schema)
    return frame.select("ordinal", "column", "count", *[F.timestamp_micros(s).alias(s) for s in TIME_STATS])


def describe_category(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """R1b. Count, distinct values, most frequent value (smallest on ties) and its frequency."""
    df = nan_to_null(df)
    others = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]
    names = others if columns is None else list(columns)
    if not names:
        return small_frame(df.sparkSession, [], "ordinal int, column string, count bigint, unique bigint, top string, freq bigint")
    counts = materialise_table(key_counts(df, names))
    stats = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"))
    best = top_of(df, names, counts, 1).select(F.col("column").alias("of"), F.col("value").alias("top"), F.col("n").alias("freq"))
    stats = stats.join(F.broadcast(best), F.col("column") == F.col("of")).drop("of")
    order = small_frame(df.sparkSession, list(enumerate(names)), "ordinal int, column string")
    full = order.join(F.broadcast(stats), "column", "left")
    zero = F.lit(0).cast("bigint")
    return full.select(
        "ordinal", "column", F.coalesce("count", zero).alias("count"), F.coalesce("unique", zero).alias("unique"), "top", "freq"
    )


def describe(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """R1. Numeric and time columns if there are any, else categories.

    A table with time columns has their statistics as times too, in ``time_mean`` to ``time_max``,
    null for numeric columns, as the others are for time columns; rows go in column order.
    """
    numbers, times = numeric_columns(df), fields_of(df, TIME_TYPES)
    if not times:
        return describe_numeric(df, facts=facts) if numbers else describe_category(df)
    numeric = describe_numeric(df, facts=facts).drop("ordinal")
    named = [f"time_{s}" for s in TIME_STATS]
    rows = [(c, *stats) for c, stats in _time_rows(df).items()]
    schema = "column string, count bigint, " + ", ".join(f"{s} bigint" for s in named)
    timed = small_frame(df.sparkSession, rows, schema).select("column", "count", *[F.timestamp_micros(s).alias(s) for s in named])
    order = [(i, c) for i, c in enumerate(c for c in df.columns if c in (*numbers, *times))]
    order = small_frame(df.sparkSession, order, "ordinal int, column string")
    both = numeric.unionByName(timed, allowMissingColumns=True)
    return F.broadcast(order).join(both, "column").select("ordinal", "column", *both.columns[1:])


def correlations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    expressions: Mapping[str, Column] | None = None,
    facts: Facts | None = None,
) -> dict[tuple[str, str], float | None]:
    """R2. Pearson r of every pair over the rows where both are present; None if one is constant.

    ``facts`` spares a pass where the moments of the columns (or expressions) are known.

    Columns are shifted by their means and scaled by their deviations first, so that sums of products lose no precision. With m
    the flags of present values, x the shifted values (0 where missing) and s their squares, the products
    of the matrices x with x, x with m, s with m and m with m hold n, both sums, both sums of squares and
    the sum of products of every pair: one pass over the rows, whatever the number of pairs.
    """
    df = nan_to_null(df)
    if expressions is None:
        names = list(columns) if columns is not None else fields_of(df, NUMERIC_TYPES + (T.BooleanType,))
        expressions = {c: column(c).cast("double") for c in names}
    else:
        names = list(expressions)
    wide = df.select(*[expressions[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    if facts is None:
        facts = column_facts(wide)
        known = [facts.moments[f"x{i}"] for i in range(len(names))]
    else:
        known = [facts.moments[c] for c in names]
    usable = [i for i, m in enumerate(known) if m.n >= 2 and not m.constant and math.isfinite(m.mean)]
    products = _products(wide, [(i, known[i].mean, known[i].std) for i in usable])
    at = {i: k for k, i in enumerate(usable)}
    out = {}
    for i, j in [(i, j) for i in range(len(names)) for j in range(i + 1)]:
        r = _pair_correlation(*(p[at[i], at[j]] for p in products), i == j) if i in at and j in at else None
        out[names[i], names[j]] = out[names[j], names[i]] = r
    return out


# Columns whose products one aggregation buffer holds; more go in blocks of pairs of such groups.
BLOCK = 256
# A variance this share of the one over all rows or less is a constant's rounding.
FLAT = 1e-20


def _pair_correlation(n, sx, sy, sxx, syy, sxy, same: bool) -> float | None:
    if n < 2:
        return None
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    if vx <= max(FLAT * n, 1e-14 * sxx) or vy <= max(FLAT * n, 1e-14 * syy):
        return None
    r = (sxy - sx * sy / n) / (vx**0.5 * vy**0.5)
    return 1.0 if same else max(-1.0, min(1.0, float(r)))


def _products(wide: DataFrame, columns: Sequence[tuple[int, float, float | None]]) -> list[np.ndarray]:
    """Matrices by pair: n, sum of x, sum of y, of their squares, and of x y, over rows where both are present.

    Each task adds up its own rows; what leaves it is as large as the matrices.
    """
    k = len(columns)
    out = [np.zeros((k, k)) for _ in range(6)]
    names = [f"x{i}" for i, _, _ in columns]
    mean, std = (np.array([c[j] for c in columns], float) for j in (1, 2))
    std = np.where(np.isfinite(std) & (std > 0), std, 1.0) if k else std
    cuts = [range(a, min(a + BLOCK, k)) for a in range(0, k, BLOCK)]
    for a in cuts:
        for b in cuts:
            if b.start > a.start:
                continue
            both = [*a] if a == b else [*a, *b]

            def rows(batches: Iterator[pa.RecordBatch], both=both, a=a, b=b) -> Iterator[pa.RecordBatch]:
                sums = [np.zeros((len(a), len(b))) for _ in range(6)]
                shift, scale = mean[both], std[both]
                for batch in batches:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                    m = (~np.isnan(x)).astype(float)
                    x = np.where(m > 0, (x - shift) / scale, 0.0)
                    left, right = slice(0, len(a)), slice(0, len(b)) if a == b else slice(len(a), None)
                    xa, xb, ma, mb = x[:, left], x[:, right], m[:, left], m[:, right]
                    parts = ((ma, mb), (xa, mb), (ma, xb), (xa * xa, mb), (ma, xb * xb), (xa, xb))
                    for s, (u, v) in zip(sums, parts):
                        s += u.T @ v
                place = np.arange(len(a) * len(b))
                yield pa.record_batch([pa.array(place), *[pa.array(s.ravel()) for s in sums]], names=["at", *"abcdef"])

            used = wide.select(*[names[i] for i in both])
            found = used.mapInArrow(rows, "at long, a double, b double, c double, d double, e double, f double")
            found = found.groupBy("at").agg(*[F.sum(c).alias(c) for c in "abcdef"]).toPandas().sort_values("at")
            for o, c in zip(out, "abcdef"):
                if len(found):
                    o[np.ix_([*a], [*b])] = found[c].to_numpy().reshape(len(a), len(b))
    # Blocks above the diagonal were left out: a pair's sums of x and of y change places there.
    upper = np.triu_indices(k, 1)
    n, sx, sy, sxx, syy, sxy = out
    for p, q in ((n, n), (sx, sy), (sxx, syy), (sxy, sxy)):
        p[upper], q[upper] = q.T[upper], p.T[upper]
    return out


def correlation_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """R2, C5. Long form ``(x, y, r)`` with every ordered pair; NULL r where undefined."""
    found = correlations(df, columns)
    return small_frame(df.sparkSession, [(a, b, r) for (a, b), r in found.items()], "x string, y string, r double")


class Report:
    """R3-R7 over one table: each underlying fact is computed once and shared."""

    def __init__(self, df: DataFrame):
        self.df = nan_to_null(df)
        self.spark = df.sparkSession

    @cached_property
    def facts(self) -> Facts:
        return column_facts(self.df, probs=QUARTILES)

    @property
    def missing_facts(self) -> tuple[int, dict[str, int]]:
        return self.facts.rows, self.facts.missing

    @cached_property
    def duplicates(self) -> int:
        return duplicate_count(self.df)

    @cached_property
    def correlation_facts(self) -> dict:
        return correlations(self.df, facts=self.facts)

    def percents(self) -> dict[str, float | None]:
        rows, counts = self.missing_facts
        return {c: 100.0 * n / rows if rows else None for c, n in counts.items()}

    def summary(self) -> DataFrame:
        return describe(self.df, self.facts)

    def correlation(self) -> DataFrame:
        facts = [(a, b, r) for (a, b), r in self.correlation_facts.items()]
        return small_frame(self.spark, facts, "x string, y string, r double")

    def missing(self) -> DataFrame:
        """R3. Missing count and percent of every column, in order."""
        _, counts = self.missing_facts
        percents = self.percents()
        rows = [(i, c, n, percents[c]) for i, (c, n) in enumerate(counts.items())]
        return small_frame(self.spark, rows, "ordinal int, column string, missing bigint, percent double")

    def insights(self) -> DataFrame:
        """R4. Sentences on missing values, strong correlations and duplicates, in that order."""
        texts = [("missing", f"Column '{c}' has {p:.2f}% missing values") for c, p in self.percents().items() if p]
        names = list(dict.fromkeys(a for a, _ in self.correlation_facts))
        for i, a in enumerate(names):
            for b in names[:i]:
                r = self.correlation_facts[a, b]
                if r is not None and abs(r) > STRONG:
                    texts.append(("correlation", f"Strong correlation between '{a}' and '{b}'"))
        if self.duplicates > 0:
            texts.append(("duplicates", f"Dataset contains {self.duplicates} duplicate rows"))
        rows = [(i, kind, text) for i, (kind, text) in enumerate(texts)]
        return small_frame(self.spark, rows, "ordinal int, kind string, message string")

    def overview(self) -> DataFrame:
        """R5. Shape, names and types."""
        rows, _ = self.missing_facts
        listed = [(i, c, t, rows, len(self.df.columns)) for i, (c, t) in enumerate(self.df.dtypes)]
        return small_frame(self.spark, listed, "ordinal int, column string, type string, rows bigint, cols int")

    def scalars(self) -> DataFrame:
        """R6. Shape, missing cells, duplicates and the first column with the largest gap."""
        rows, counts = self.missing_facts
        percents = self.percents()
        top = max(counts, key=lambda c: counts[c], default=None)
        row = (rows, len(self.df.columns), sum(counts.values()), self.duplicates, top, percents.get(top))
        schema = (
            "rows bigint, cols int, total_missing bigint, duplicates bigint, top_missing string, top_missing_val double"
        )
        return small_frame(self.spark, [row], schema)

    def basic(self) -> dict[str, DataFrame]:
        return {
            "scalars": self.scalars(),
            "summary": self.summary(),
            "missing": self.missing(),
            "correlation": self.correlation(),
            "insights": self.insights(),
        }
