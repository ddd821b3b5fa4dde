"""C1, C8a, C12d, D3: histograms, with automatic bins per group.

Automatic width (n values, range R, interquartile range Q):
``fd = 2 Q n^(-1/3)``, ``sturges = R / (log2 n + 1)``, ``sq = R / sqrt n``,
``width = min(max(fd, sq / 2), sturges)``, at least 1 for integers, and
``bins = ceil(R / width)``. A single repeated value gets one bin of width 1 around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import join_group_stats, literal, nan_to_null, quoted, require_columns, small_frame
from .facts import COLUMN, VALUE, column_group_facts, integer_columns


def with_bins(facts: DataFrame, bins: int | None = None, whole: Column | None = None) -> DataFrame:
    """Facts plus ``left``, ``right``, ``bins`` and ``width`` of each group's histogram."""
    reach = F.col("hi") - F.col("lo")
    n = F.col("n").cast("double")
    rule = F.lit(1.0)
    if not bins:
        rule = F.least(
            F.greatest(2 * (F.col("q3") - F.col("q1")) * F.pow(n, F.lit(-1 / 3)), reach / F.sqrt(n) / 2),
            reach / (F.log2(n) + 1),
        )
    if whole is not None:
        rule = F.when(whole & (rule < 1) & (rule > 0), 1.0).otherwise(rule)
    flat = F.col("hi") == F.col("lo")
    left = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    right = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    wanted = F.lit(bins) if bins else F.when(flat | (rule <= 0), 1).otherwise(F.ceil(F.try_divide(reach, rule)))
    sized = facts.withColumns({"left": left, "right": right, "bins": wanted.cast("bigint")})
    return sized.withColumn("width", (F.col("right") - F.col("left")) / F.col("bins"))


def bin_counts(long: DataFrame, keys: Sequence[str], sized: DataFrame, value: str = VALUE) -> DataFrame:
    """``(keys, bin, left, right, count)`` of every bin, empty ones included."""
    keys = list(keys)
    params = sized.select(*keys, "n", "left", "width", "bins")
    at = F.floor((F.col(value) - F.col("left")) / F.col("width"))
    last = F.col("bins") - 1
    counted = (
        join_group_stats(long, params, keys, "n")
        .select(*keys, F.least(at, last).alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("count"))
    )
    return _with_edges(counted, keys, sized)


def _with_edges(counted, keys, sized):
    """Every bin with its edges; those that hold nothing count 0."""
    bins = F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)
    every = sized.select(*keys, "left", "width", F.explode(bins).alias("bin"))
    edge = F.col("left") + F.col("bin") * F.col("width")
    edges = every.select(*keys, "bin", edge.alias("left"), (edge + F.col("width")).alias("right"))
    full = edges.join(counted, [*keys, "bin"], "left")
    return full.select(*keys, "bin", "left", "right", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int | None = None) -> DataFrame:
    """C1, D3. Histogram of each numeric column; automatic bins unless a number is given."""
    require_columns(df, columns)
    return column_bin_counts(df, column_bins(df, column_group_facts(df, columns, quartiles=not bins), bins))


def column_bins(df: DataFrame, facts: DataFrame, bins: int | None = None) -> DataFrame:
    """Bins for facts with one group per column, whole numbers treated as such."""
    whole = integer_columns(df, df.columns)
    return with_bins(facts, bins, F.col(COLUMN).isin(*whole) if whole else None)


def column_bin_counts(df: DataFrame, sized: DataFrame) -> DataFrame:
    """``bin_counts`` with one group per column: the few parameters go into the plan as literals."""
    groups = sized.select(COLUMN, "left", "width", "bins").collect()
    if not groups:
        return bin_counts(sized.select(COLUMN, F.lit(0.0).alias(VALUE)), [COLUMN], sized)
    cells = ", ".join(f"{i}, double({quoted(g[COLUMN])})" for i, g in enumerate(groups))
    long = nan_to_null(df).selectExpr(f"stack({len(groups)}, {cells}) as (k, v)").filter("v is not null")

    def known(name):
        return f"get(array({', '.join(literal(g[name]) if name != 'bins' else f'{g[name]}L' for g in groups)}), k)"

    binned = long.selectExpr("k", f"least(floor((v - {known('left')}) / {known('width')}), {known('bins')} - 1) as bin")
    counted = binned.groupBy("k", "bin").agg(F.count("*").alias("count"))
    names = small_frame(df.sparkSession, [(i, g[COLUMN]) for i, g in enumerate(groups)], f"k int, {COLUMN} string")
    return _with_edges(counted.join(F.broadcast(names), "k").drop("k"), [COLUMN], sized)
