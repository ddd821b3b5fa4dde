"""What to do about missing values.

The policy walks the columns in order, and rows it drops change the ratios of later
columns. The walk needs only how often each combination of gaps occurs, so one grouped
count replaces a job per column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import INTEGER_TYPES, aggregate_once, as_double, column, nan_to_null, numeric_columns, small_frame
from .frequencies import modes
from .moments import gap_masks, gaps_of
from .quantiles import column_quantiles
from .validate import count_missing

DROP_THRESHOLD = 0.4
ROW_DROP_BELOW = 0.05
# Combinations of gaps the driver folds over; beyond, one count per row-dropping column.
MAX_PATTERNS = 100_000

# A whole-number column with gaps is double by the time the policy is asked, so every integer type takes the median.
MEDIAN_TYPES = (*INTEGER_TYPES, T.DoubleType)

DROP_COLUMN, DROP_ROWS, FILL_MEDIAN, FILL_MODE = "drop_column", "drop_rows", "fill_median", "fill_mode"


@dataclass(frozen=True)
class NullStep:
    ordinal: int
    column: str
    null_count: int
    rows_before: int
    action: str
    fill_number: float | None = None
    fill_text: str | None = None

    @property
    def ratio(self) -> float:
        return self.null_count / self.rows_before


@dataclass(frozen=True)
class NullPlan:
    """A fitted null policy. Applying it is one lazy projection and filter."""

    steps: tuple[NullStep, ...]
    rows: int
    missing: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, threshold: float = DROP_THRESHOLD, max_patterns: int = MAX_PATTERNS) -> NullPlan:
        df = nan_to_null(df)
        names = [f.name for f in df.schema.fields if f.nullable]
        patterns = _gap_patterns(df, names, max_patterns)
        if patterns is None:
            rows, missing = count_missing(df)
            decided = _walk_by_jobs(df, [c for c in names if missing[c]], threshold)
        else:
            rows = sum(n for _, n in patterns)
            counts = {c: sum(n for flags, n in patterns if flags[i]) for i, c in enumerate(names)}
            missing = {c: counts.get(c, 0) for c in df.columns}
            decided = _walk_patterns(patterns, names, threshold)
        return cls(_with_fills(df, decided, rows), rows, missing)

    def columns(self, action: str) -> list[str]:
        return [s.column for s in self.steps if s.action == action]

    def apply(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)
        dropped = set(self.columns(DROP_COLUMN))
        for c in self.columns(DROP_ROWS):
            df = df.filter(column(c).isNotNull())
        fills = {s.column: s for s in self.steps if s.action in (FILL_MEDIAN, FILL_MODE)}

        def filled(field):
            c, step = column(field.name), fills.get(field.name)
            if step is None:
                return c
            if step.action == FILL_MEDIAN:
                return F.coalesce(c.cast("double"), F.lit(step.fill_number)).alias(field.name)
            return F.coalesce(c, F.lit(step.fill_text).cast(field.dataType)).alias(field.name)

        return df.select(*[filled(f) for f in df.schema.fields if f.name not in dropped])

    def table(self, df: DataFrame) -> DataFrame:
        rows = [
            (s.ordinal, s.column, s.null_count, s.rows_before, s.ratio, s.action, s.fill_number, s.fill_text)
            for s in self.steps
        ]
        schema = (
            "ordinal int, column string, null_count bigint, rows_before bigint, ratio double, "
            "action string, fill_number double, fill_text string"
        )
        return small_frame(df.sparkSession, rows, schema)


def handle_nulls(df: DataFrame, threshold: float = DROP_THRESHOLD) -> DataFrame:
    """P1. Fit and apply the null policy."""
    return NullPlan.fit(df, threshold).apply(df)


def _gap_patterns(df, names, max_patterns):
    """How often each combination of gaps occurs: ``[(flags, rows)]``, or None if too many."""
    masks = gap_masks(names)
    flagged = df.selectExpr(*[f"{m} as m{i}" for i, m in enumerate(masks)] or ["0L as m0"])
    found = flagged.groupBy(*flagged.columns).agg(F.count("*").alias("rows")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        return None
    return [(gaps_of(r[:-1], len(names)), r["rows"]) for r in found]


def _action(nulls, rows, threshold):
    ratio = nulls / rows
    return DROP_COLUMN if ratio > threshold else DROP_ROWS if ratio < ROW_DROP_BELOW else "fill"


def _walk_patterns(patterns, gappy, threshold):
    """The policy over pattern counts: ``[(column, nulls, rows, action, row-drops before)]``."""
    decided, dropping = [], []
    for i, c in enumerate(gappy):
        rows = sum(n for _, n in patterns)
        nulls = sum(n for flags, n in patterns if flags[i])
        if nulls == 0:
            continue
        action = _action(nulls, rows, threshold)
        decided.append((c, nulls, rows, action, tuple(dropping)))
        if action == DROP_ROWS:
            dropping.append(c)
            patterns = [(flags, n) for flags, n in patterns if not flags[i]]
    return decided


def _walk_by_jobs(df, gappy, threshold):
    """The same walk by counting anew after each row-dropping column."""
    decided, dropping, todo = [], [], list(gappy)
    while todo:
        alive = df
        for c in dropping:
            alive = alive.filter(column(c).isNotNull())
        found = aggregate_once(alive, {None: F.count("*")} | {("c", c): F.count_if(column(c).isNull()) for c in todo})
        rows = found[None]
        while todo:
            c = todo.pop(0)
            nulls = found["c", c]
            if nulls == 0:
                continue
            action = _action(nulls, rows, threshold)
            decided.append((c, nulls, rows, action, tuple(dropping)))
            if action == DROP_ROWS:
                dropping.append(c)
                break
    return decided


def _with_fills(df, decided, rows):
    """Medians and modes over the rows alive at each step."""
    types = {f.name: f.dataType for f in df.schema.fields}
    medians, most = {}, {}
    for c, _nulls, _rows, action, before in decided:
        if action != "fill":
            continue
        value = column(c)
        if before:
            alive = F.lit(True)
            for b in before:
                alive = alive & column(b).isNotNull()
            value = F.when(alive, value)
        (medians if isinstance(types[c], MEDIAN_TYPES) else most)[c] = value
    found_medians = column_quantiles(df, medians, [0.5], rows)
    found_modes = modes(df, most)
    ordinals = {c: i for i, c in enumerate(df.columns)}
    steps = []
    for c, nulls, before, action, _drops in decided:
        number = text = None
        if c in medians:
            action, number = FILL_MEDIAN, found_medians[c][0]
        elif c in most:
            action, text = FILL_MODE, found_modes[c]
        steps.append(NullStep(ordinals[c], c, nulls, before, action, number, text))
    return tuple(steps)


def fill_nulls(df: DataFrame, strategy: str = "mean") -> DataFrame:
    """P8. One strategy for the whole table: mean, median, mode or drop."""
    df = nan_to_null(df)
    if strategy == "drop":
        return df.dropna()
    if strategy == "mean":
        fills = aggregate_once(df, {c: F.avg(as_double(c)) for c in numeric_columns(df)})
    elif strategy == "median":
        fills = {c: q[0] for c, q in column_quantiles(df, {c: column(c) for c in numeric_columns(df)}, [0.5]).items()}
    elif strategy == "mode":
        fills = modes(df, {c: column(c) for c in df.columns})
    else:
        raise ValueError(f"Unknown strategy for missing values: {strategy!r}")

    def filled(field):
        c, fill = column(field.name), fills.get(field.name)
        if field.name not in fills:
            return c
        if strategy == "mode":
            return F.coalesce(c, F.lit(fill).cast(field.dataType)).alias(field.name)
        return F.coalesce(c.cast("double"), F.lit(fill).cast("double")).alias(field.name)

    return df.select(*[filled(f) for f in df.schema.fields])
