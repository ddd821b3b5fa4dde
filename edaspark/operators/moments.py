"""Row count, missing values and moments of all columns: the pass most operators start from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..common import FLOAT_TYPES, NUMERIC_TYPES, aggregate_once, fields_of, literal, quoted

FLAGS_PER_MASK = 62


@dataclass(frozen=True)
class Moments:
    n: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None

    @property
    def constant(self) -> bool:
        return self.n > 0 and self.low == self.high


# Size of a quantile sketch, and the half-width of the rank bracket it gives, as a share of
# the rows; over twice the sketch's error.
SKETCH_SIZE = 4096
MARGIN = 0.0025
LOWEST, HIGHEST = float("-inf"), float("inf")


@dataclass(frozen=True)
class Sketch:
    """Brackets (lo, hi) of the values at some probabilities, and about how many values differ."""

    probs: tuple[float, ...]
    brackets: tuple[tuple[float, float], ...]
    distinct: int

    def covers(self, probs: Sequence[float]) -> bool:
        return set(probs) <= set(self.probs)

    def at(self, probs: Sequence[float]) -> Sketch:
        return Sketch(tuple(probs), tuple(self.brackets[self.probs.index(p)] for p in probs), self.distinct)


@dataclass(frozen=True)
class Facts:
    """What one pass over a table tells of it."""

    rows: int
    missing: dict[str, int]
    moments: dict[str, Moments]
    sketches: dict[str, Sketch] = field(default_factory=dict)


def literal_array(values) -> str:
    return f"array({', '.join(map(literal, values))})"


def sketched_quantiles(value: str, ranks: str) -> str:
    """Aggregate expression; null without values, of which the sketch alone would make an error."""
    sketch = f"kll_sketch_agg_double({value}, {SKETCH_SIZE})"
    return f"if(count({value}) > 0, kll_sketch_get_quantile_double({sketch}, {ranks}), null)"


def sketch_expressions(value: str, probs: Sequence[float], margin: float = MARGIN) -> dict[str, str]:
    """Aggregates that a Sketch is made of."""
    asked = [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    return {"at": sketched_quantiles(value, literal_array(asked)), "distinct": f"approx_count_distinct({value})"}


def sketch_of(at: Sequence[float] | None, distinct: int, probs: Sequence[float], margin: float = MARGIN) -> Sketch:
    at = at or [None] * 2 * len(probs)
    ends = [
        (LOWEST if p - margin <= 0 else at[2 * j], HIGHEST if p + margin >= 1 else at[2 * j + 1])
        for j, p in enumerate(probs)
    ]
    return Sketch(tuple(probs), tuple(ends), distinct)


def column_facts(df: DataFrame, columns: Sequence[str] | None = None, probs: Sequence[float] = ()) -> Facts:
    """Missing values of every column, moments of numeric and boolean ones (as 0 and 1).

    NaN counts as missing. Columns are aggregated in their order, so that a wide table is
    read in chunks of columns, each of them once. With ``probs`` the same pass sketches the
    quantiles of numeric columns, for ``column_quantiles`` to go on from.
    """
    names = list(df.columns if columns is None else columns)
    numeric = set(fields_of(df, NUMERIC_TYPES))
    floats, numbers = set(fields_of(df, FLOAT_TYPES)), set(fields_of(df, NUMERIC_TYPES + (T.BooleanType,)))
    exprs: dict = {"rows": "count(*)"}
    for c in names:
        if c not in numbers:
            exprs[c, "n"] = f"count({quoted(c)})"
            continue
        x = f"double({quoted(c)})"
        x = f"if(isnan({x}), null, {x})" if c in floats else x
        for stat, f in (("n", "count"), ("mean", "avg"), ("std", "stddev_samp"), ("low", "min"), ("high", "max")):
            exprs[c, stat] = f"{f}({x})"
        if probs and c in numeric:
            exprs |= {(c, k): e for k, e in sketch_expressions(x, sorted(probs)).items()}
    found = aggregate_once(df, exprs)
    rows = found["rows"]
    moments = {
        c: Moments(*[found[c, stat] for stat in ("n", "mean", "std", "low", "high")]) for c in names if c in numbers
    }
    sketches = {c: sketch_of(found[c, "at"], found[c, "distinct"], sorted(probs)) for c in names if (c, "at") in found}
    return Facts(rows, {c: rows - found[c, "n"] for c in names}, moments, sketches)


def gap_masks(names: Sequence[str]) -> list[str]:
    """One bit per column, set where its value is null, packed into as few integers as it takes."""
    masks = []
    for start in range(0, len(names), FLAGS_PER_MASK):
        part = names[start : start + FLAGS_PER_MASK]
        masks.append(" + ".join(f"if({quoted(c)} is null, {1 << i}L, 0L)" for i, c in enumerate(part)))
    return masks


def gaps_of(masks: Sequence[int], n: int) -> list[bool]:
    """The flags back from their integers."""
    return [bool(masks[i // FLAGS_PER_MASK] >> (i % FLAGS_PER_MASK) & 1) for i in range(n)]
