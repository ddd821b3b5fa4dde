"""The detailed profile."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import (
    AGG_CHUNK,
    INTEGER_TYPES,
    NUMERIC_TYPES,
    TIME_TYPES,
    aggregate_once,
    column,
    fields_of,
    materialise,
    nan_to_null,
    numeric_columns,
    quoted,
    reject_nested,
    small_frame,
    spread,
)
from .frequencies import as_text, distinct_counts, top_counts
from .quantiles import column_quantiles
from .summary import Report, correlations, micros
from .validate import missing_flag

# Thresholds of the alerts.
MANY_CATEGORIES = 50
HIGH_CORRELATION = 0.8
HIGH_SKEW = 2.0
MANY_ZEROS = 0.1

PERCENTS = [0.05, 0.25, 0.5, 0.75, 0.95]


def kind_of(field: T.StructField) -> str:
    if isinstance(field.dataType, NUMERIC_TYPES):
        return "numeric"
    if isinstance(field.dataType, TIME_TYPES):
        return "datetime"
    return "boolean" if isinstance(field.dataType, T.BooleanType) else "text"


def numeric_detail(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D2. Moments, quantiles, median absolute deviation and sign counts of numeric columns.

    Skewness and excess kurtosis are the population ones.
    """
    df = nan_to_null(df)
    names = numeric_columns(df) if columns is None else list(columns)
    values = {c: column(c).cast("double") for c in names}
    basic = (F.count, F.avg, F.stddev_samp, F.var_samp, F.sum, F.min, F.max, F.skewness, F.kurtosis)
    exprs = {}
    for c, x in values.items():
        exprs |= {(c, f.__name__): f(x) for f in basic}
        exprs |= {(c, "zeros"): F.count_if(x == 0), (c, "negatives"): F.count_if(x < 0)}
    found = aggregate_once(df, exprs)
    rows = max((found[c, "count"] for c in names), default=0)
    quantiles = column_quantiles(df, values, PERCENTS, rows)
    distances = {c: F.abs(x - F.lit(quantiles[c][2])) for c, x in values.items() if quantiles[c][2] is not None}
    deviations = column_quantiles(df, distances, [0.5], rows)
    out = []
    for c in names:
        n, mean, std, var, total, lo, hi, skew, kurt = (found[c, f.__name__] for f in basic)
        q = quantiles[c]
        out.append(
            (c, n, mean, std, var, std / mean if std is not None and mean else None, total, lo, *q, hi,
             hi - lo if n else None, q[3] - q[1] if n else None, deviations.get(c, [None])[0], skew, kurt,
             found[c, "zeros"], found[c, "negatives"])
        )
    doubles = "mean std variance cv sum min q05 q25 q50 q75 q95 max range iqr mad skewness kurtosis".split()
    schema = "column string, n bigint, " + ", ".join(f"{d} double" for d in doubles) + ", zeros bigint, negatives bigint"
    return small_frame(df.sparkSession, out, schema)


def common_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """D4. The k most frequent values of each column with their percent of non-null values."""
    df = nan_to_null(df)
    names = list(columns or df.columns)
    totals = aggregate_once(df, {c: F.count(column(c)) for c in names})
    total = small_frame(df.sparkSession, list(totals.items()), "column string, total bigint")
    top = top_counts(df, names, k).join(F.broadcast(total), "column")
    return top.select("column", "rank", "value", "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))


def extreme_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """D4. The k smallest and k largest distinct values of each numeric column, with counts.

    Each batch of rows names its own k of either end; only the values that are left are counted,
    in a second pass. Whole numbers stay whole on the way; ``exact`` has every digit of a value.
    """
    df = nan_to_null(df)
    names = numeric_columns(df) if columns is None else list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = [c for c in names if isinstance(types[c], INTEGER_TYPES)]
    parts = [_extremes(df, named, kind, k) for kind, named in (("long", whole), ("double", [c for c in names if c not in whole])) if named]
    schema = "column string, side string, rank int, value double, n bigint, exact string"
    if not parts:
        return small_frame(df.sparkSession, [], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _extremes(df: DataFrame, names: Sequence[str], kind: str, k: int) -> DataFrame:
    plus = " + 0D" if kind == "double" else ""
    wide = df.selectExpr(*[f"cast({quoted(c)} as {kind}){plus} as v{i}" for i, c in enumerate(names)])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for i, cells in enumerate(batch.columns):
                found = np.unique(cells.drop_null().to_numpy(zero_copy_only=False))
                found = found if len(found) <= 2 * k else np.concatenate((found[:k], found[-k:]))
                slots += [i] * len(found)
                values.append(found)
            yield pa.record_batch([pa.array(slots, pa.int32()), pa.array(np.concatenate(values))], names=["slot", "value"])

    left = wide.mapInArrow(ends, f"slot int, value {kind}").distinct()

    def ranked(order, side):
        rank = F.row_number().over(Window.partitionBy("slot").orderBy(order))
        return left.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("side", F.lit(side))

    both = materialise(ranked(F.asc("value"), "smallest").unionByName(ranked(F.desc("value"), "largest")))  # 2 k a column
    pairs = ", ".join(f"{i}, v{i}" for i in range(len(names)))
    long = wide.selectExpr(f"stack({len(names)}, {pairs}) as (slot, value)")
    kept = long.join(F.broadcast(both.select("slot", "value").distinct()), ["slot", "value"], "left_semi")
    counts = kept.groupBy("slot", "value").agg(F.count("*").alias("n"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("slot") + 1)
    return both.join(F.broadcast(counts), ["slot", "value"]).select(
        label.alias("column"), "side", "rank", F.col("value").cast("double").alias("value"), "n", F.col("value").cast("string").alias("exact")
    )


def text_detail(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D5. Lengths of text columns and how many texts are empty."""
    names = fields_of(df, (T.StringType,)) if columns is None else list(columns)
    lengths = {c: F.length(column(c)) for c in names}
    exprs = {}
    for c, x in lengths.items():
        exprs |= {(c, f.__name__): f(x) for f in (F.count, F.min, F.avg, F.max)}
        exprs[c, "empty"] = F.count_if(x == 0)
    found = aggregate_once(df, exprs)
    medians = column_quantiles(df, lengths, [0.5])
    rows = [
        (c, found[c, "count"], found[c, "min"], found[c, "avg"], medians[c][0], found[c, "max"], found[c, "empty"])
        for c in names
    ]
    schema = (
        "column string, n bigint, min_length int, mean_length double, median_length double, max_length int, empty bigint"
    )
    return small_frame(df.sparkSession, rows, schema)


def word_counts(df: DataFrame, name: str) -> DataFrame:
    """D5. How often each word (run of letters and digits, lower case) occurs in whole texts."""
    words = F.explode(F.split(F.lower(column(name)), r"[^\p{L}\p{N}]+")).alias("word")
    texts = spread(df.select(column(name)), df.count())
    return texts.select(words).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def time_detail(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D6. Earliest, latest and span in seconds of date and time columns."""
    names = fields_of(df, TIME_TYPES) if columns is None else list(columns)
    exprs = {}
    for c in names:
        x = micros(column(c))
        exprs |= {(c, f.__name__): f(x) for f in (F.count, F.min, F.max)}
    found = aggregate_once(df, exprs)
    rows = [(c, found[c, "count"], found[c, "min"], found[c, "max"]) for c in names]
    frame = small_frame(df.sparkSession, rows, "column string, n bigint, lo bigint, hi bigint")
    return frame.select(
        "column",
        "n",
        F.timestamp_micros("lo").alias("min"),
        F.timestamp_micros("hi").alias("max"),
        ((F.col("hi") - F.col("lo")) / 1e6).alias("range_seconds"),
    )


def nullity_correlation(df: DataFrame) -> DataFrame:
    """D8. Correlation of missingness between columns that are missing somewhere but not everywhere."""
    flags = {c: missing_flag(df, c).cast("int") for c in df.columns}
    known = aggregate_once(df, {(c, f.__name__): f(x) for c, x in flags.items() for f in (F.min, F.max)})
    mixed = {c: x for c, x in flags.items() if known[c, "min"] != known[c, "max"]}
    found = correlations(df, expressions=mixed)
    return small_frame(df.sparkSession, [(a, b, r) for (a, b), r in found.items()], "x string, y string, r double")


def sample(df: DataFrame, order: Sequence[str], k: int = 5, last: bool = False) -> DataFrame:
    """D10. First or last k rows by a key."""
    keys = [column(c).desc() if last else column(c).asc() for c in order]
    return df.orderBy(*keys).limit(k)


VARIABLES = (
    "ordinal int, column string, kind string, n bigint, missing bigint, missing_pct double, "
    "distinct bigint, distinct_pct double, unique bigint, constant boolean"
)
# Binary logarithm of a sketch's registers: a standard error of 1.04 / sqrt(2^12), 1.6 %.
SKETCH_BITS = 12


def distinct_sketches(df: DataFrame) -> DataFrame:
    """D1. ``(column, sketch, low, high)``: an HLL sketch of every column's values, and hashes that differ unless all values are equal.

    Sketches of parts of a table, or of several tables, merge (see ``merged_sketches``): keep them beside the parts to count without a scan.
    """
    texts = {c: as_text(df, c) for c in df.columns}
    exprs = []
    for i, text in enumerate(texts.values()):
        exprs += [F.hll_sketch_agg(text, F.lit(SKETCH_BITS)).alias(f"s{i}"), *(f(F.when(text.isNotNull(), F.xxhash64(text))).alias(f"{x}{i}") for f, x in ((F.min, "l"), (F.max, "h")))]
    parts = []
    for start in range(0, len(df.columns), AGG_CHUNK // 3):
        names = df.columns[start : start + AGG_CHUNK // 3]
        row = df.agg(*exprs[3 * start : 3 * (start + len(names))])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"s{start + i}").alias("sketch"), F.col(f"l{start + i}").alias("low"), F.col(f"h{start + i}").alias("high")) for i, c in enumerate(names)]
        parts.append(row.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionAll, parts)


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """D1. One sketch per column, of all tables or parts whose sketches are given."""
    return sketches.groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"), F.min("low").alias("low"), F.max("high").alias("high"))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """D1. ``(column, distinct, constant)`` of sketches; NULLs are no value."""
    return sketches.select("column", F.hll_sketch_estimate("sketch").alias("distinct"), F.coalesce(F.col("low") == F.col("high"), F.lit(False)).alias("constant"))


class Detail(Report):
    """The detailed profile; shares facts with the basic report."""

    def __init__(self, df: DataFrame):
        reject_nested(df)
        super().__init__(df)

    @cached_property
    def distinct_facts(self) -> dict[str, tuple[int, int]]:
        """Distinct values, and values seen once, of every column."""
        return distinct_counts(self.df)

    def variables(self, approximate: bool = False) -> DataFrame:
        """D1. Kind, missing, distinct and unique values of every column.

        ``approximate`` takes distinct values from mergeable sketches, in the table's one aggregate and without a shuffle of values; they err by
        2 % or so, and values seen once are not known (NULL). Constant columns are told exactly.
        """
        rows, missing = self.missing_facts
        if approximate:
            return self._approximate(rows, missing)
        out = []
        for i, field in enumerate(self.df.schema.fields):
            c = field.name
            n = rows - missing[c]
            distinct, unique = self.distinct_facts[c]
            out.append(
                (i, c, kind_of(field), n, missing[c], 100.0 * missing[c] / rows if rows else None, distinct,
                 100.0 * distinct / n if n else None, unique, distinct == 1)
            )
        return small_frame(self.spark, out, VARIABLES)

    def _approximate(self, rows: int, missing: dict[str, int]) -> DataFrame:
        estimates = distinct_estimates(distinct_sketches(self.df))
        found = {r["column"]: r for r in estimates.collect()}
        out = []
        for i, field in enumerate(self.df.schema.fields):
            c, n = field.name, rows - missing[field.name]
            distinct, constant = found[c]["distinct"], bool(found[c]["constant"])
            distinct = min(n, 1 if constant else max(distinct, 2)) if n else 0
            out.append(
                (i, c, kind_of(field), n, missing[c], 100.0 * missing[c] / rows if rows else None, distinct,
                 100.0 * distinct / n if n else None, None, constant)
            )
        return small_frame(self.spark, out, VARIABLES)

    def alerts(self) -> DataFrame:
        """D11. ``(column, alert, value)`` for everything worth a second look."""
        rows, missing = self.missing_facts
        names = numeric_columns(self.df)
        exprs = {}
        for c in names:
            x = column(c).cast("double")
            exprs |= {(c, "skew"): F.skewness(x), (c, "zeros"): F.count_if(x == 0)}
        shape = aggregate_once(self.df, exprs)
        out = []
        for field in self.df.schema.fields:
            c, n = field.name, rows - missing[field.name]
            distinct, _ = self.distinct_facts[c]
            if distinct == 1:
                out.append((c, "constant", 1.0))
            if n == rows > 1 and distinct == n:
                out.append((c, "unique", float(distinct)))
            if kind_of(field) == "text" and distinct > MANY_CATEGORIES:
                out.append((c, "high_cardinality", float(distinct)))
            if missing[c]:
                out.append((c, "missing", 100.0 * missing[c] / rows))
            if c in names and shape[c, "skew"] is not None and abs(shape[c, "skew"]) > HIGH_SKEW:
                out.append((c, "skewed", shape[c, "skew"]))
            if c in names and n and shape[c, "zeros"] / n > MANY_ZEROS:
                out.append((c, "zeros", 100.0 * shape[c, "zeros"] / n))
        order = list(dict.fromkeys(a for a, _ in self.correlation_facts))
        for i, a in enumerate(order):
            strong = [self.correlation_facts[a, b] for b in order if b != a]
            top = max((abs(r) for r in strong if r is not None), default=0.0)
            if top > HIGH_CORRELATION:
                out.append((a, "high_correlation", top))
        if self.duplicates:
            out.append((None, "duplicates", float(self.duplicates)))
        return small_frame(self.spark, out, "column string, alert string, value double")
