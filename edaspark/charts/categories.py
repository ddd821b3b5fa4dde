"""Tables behind charts of categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import column, join_group_stats, materialise, nan_to_null, require_columns
from ..operators.frequencies import top_counts
from .density import CURVE_POINTS, VIOLIN_POINTS, curves, scaled
from .facts import VALUE, group_facts, melted
from .histogram import bin_counts, with_bins

TOP_BARS = 10
MAX_FACETS = 6
MAX_FACET_COLUMNS = 6
# Columns a wide cross-tabulation has at most unless told otherwise.
MAX_PIVOT = 10_000
WHISKER = 1.5
VIOLIN_CUT = 2.0


def bars(df: DataFrame, columns: Sequence[str], k: int = TOP_BARS) -> DataFrame:
    """C3. The ten most frequent values of each categorical column, as text, nulls left out."""
    require_columns(df, columns)
    return top_counts(df, columns, k)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """C9, C10. Count ``(a, b, n)`` of every combination that occurs; rows with a null are out."""
    require_columns(df, [a, b])
    pairs = nan_to_null(df).select(column(a).alias("a"), column(b).alias("b")).dropna()
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, max_columns: int = MAX_PIVOT) -> DataFrame:
    """C10. One row per value of a, one column per value of b in order, 0 where none occurs.

    Over ``max_columns`` values of b raise, as a table has no more columns; ``crosstab`` has no limit. The
    row labels stand in column ``a``, or if b has such a value, under a's own name, or with
    underscores added; so do values of b that differ from another in case only.
    """
    cells = crosstab(df, a, b)
    labels = [r[0] for r in cells.select("b").distinct().limit(max_columns + 1).collect()]
    if len(labels) > max_columns:
        raise ValueError(f"Column '{b}' has over {max_columns} values; use the long form.")
    labels = sorted(labels)
    wide = cells.groupBy("a").pivot("b", labels).agg(F.sum("n")).na.fill(0).orderBy("a")
    names = _apart(wide.columns[1:])
    taken = {n.lower() for n in names}
    head = next((n for n in ("a", a) if n.lower() not in taken), a)
    while head.lower() in taken:
        head += "_"
    return wide.toDF(head, *names)


def _apart(names: Sequence[str]) -> list[str]:
    """The names, with underscores added to those that another one before equals but for case."""
    out, taken = [], set()
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stacked(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """C9. Counts of b within each value of a, or shares (0 to 1) of that value's rows."""
    cells = crosstab(df, a, b)
    if not normalize:
        return cells
    cells = materialise(cells)
    totals = materialise(cells.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("cells")))
    whole = join_group_stats(cells, totals, ["a"], "cells")
    return whole.select("a", "b", "n", (F.col("n") / F.col("total")).alias("share"))


def violin(df: DataFrame, value: str, category: str, points: int = VIOLIN_POINTS) -> dict[str, DataFrame]:
    """C11. Box and density of a numeric column in each category."""
    long = _by_category(df, value, category)
    facts = group_facts(long, ["category"])
    return {"box": _boxes(long, facts), "density": _violins(long, facts, points)}


def violin_box(df: DataFrame, value: str, category: str) -> DataFrame:
    """C11. Quartiles and whiskers: the most extreme values within 1.5 interquartile ranges."""
    long = _by_category(df, value, category)
    return _boxes(long, group_facts(long, ["category"]))


def violin_density(df: DataFrame, value: str, category: str, points: int = VIOLIN_POINTS) -> DataFrame:
    """C11b. Density per category over its range, two bandwidths further on either side."""
    long = _by_category(df, value, category)
    return _violins(long, group_facts(long, ["category"], quartiles=False), points)


def _by_category(df, value, category):
    require_columns(df, [value, category])
    return (
        nan_to_null(df).select(column(category).alias("category"), column(value).cast("double").alias(VALUE)).dropna()
    )


def _boxes(long, facts):
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    fences = facts.select("category", "n", "q1", "q2", "q3", (F.col("q1") - reach).alias("a"), (F.col("q3") + reach).alias("b"))
    v = F.col(VALUE)
    within = F.when(v.between(F.col("a"), F.col("b")), v)
    return (
        join_group_stats(long, fences, ["category"], "n")
        .groupBy("category", "n", "q1", "q2", "q3")
        .agg(F.min(within).alias("whisker_low"), F.max(within).alias("whisker_high"))
        .select("category", "n", "q1", F.col("q2").alias("median"), "q3", "whisker_low", "whisker_high")
    )


def _violins(long, facts, points):
    return curves(long, ["category"], facts, points, extend=VIOLIN_CUT)


def facet_categories(df: DataFrame, category: str, k: int = MAX_FACETS) -> list:
    """C12. The categories shown: the most frequent, ties by value."""
    require_columns(df, [category])
    counts = df.select(column(category).alias("c")).dropna().groupBy("c").agg(F.count("*").alias("n"))
    return [r["c"] for r in counts.orderBy(F.desc("n"), F.asc("c")).limit(k).collect()]


def _facet_rows(df, columns, category, max_categories, max_columns, names):
    require_columns(df, [*columns, category])
    shown = facet_categories(df, category, max_categories)
    kept = df.filter(column(category).isin(*shown)) if shown else df.filter(F.lit(False))
    return melted(kept, list(columns)[:max_columns], [category], *names[1:], key_names=names[:1])


def facet_melt(
    df: DataFrame,
    columns: Sequence[str],
    category: str,
    max_categories: int = MAX_FACETS,
    max_columns: int = MAX_FACET_COLUMNS,
) -> DataFrame:
    """C12a-c. Rows of the shown categories, the first columns melted to (Variable, Value).

    Where the category's own name is one of these, it keeps it and they get underscores.
    """
    return _facet_rows(df, columns, category, max_categories, max_columns, _apart([category, "Variable", "Value"]))


def facet_grid(
    df: DataFrame,
    columns: Sequence[str],
    category: str,
    points: int = CURVE_POINTS,
    max_categories: int = MAX_FACETS,
    max_columns: int = MAX_FACET_COLUMNS,
) -> dict[str, DataFrame]:
    """C12d. Histogram and density of each (category, variable), with bins of their own."""
    keys = ["category", "Variable"]
    long = _facet_rows(df, columns, category, max_categories, max_columns, [*keys, "Value"])
    facts = group_facts(long, keys, "Value")
    sized = with_bins(facts)
    density = scaled(curves(long, keys, facts, points, value="Value"), keys, sized)
    return {"histogram": bin_counts(long, keys, sized, "Value"), "density": density}
