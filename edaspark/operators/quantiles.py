"""Exact linearly interpolated quantiles, without holding a column's values in one buffer.

The built-in ``percentile`` keeps every distinct value of a group in one aggregation
buffer, so it serves only row counts checked to be small. Beyond, a bounded sketch
brackets each wanted rank. One more pass then keeps distinct values inside the brackets
and merely counts the rows between them, so the ranks are exact. A bracket that missed
its rank is found out by those counts and widened.

Between two neighbouring values a and b the quantile is a + (b - a) share; next to an infinite value it
is that infinity, between opposite ones NaN, and at a rank that falls on a value it is that value. Both ways follow this.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import aggregate_once, column, group_sizes, join_group_stats, literal, materialise
from .moments import (
    HIGHEST,
    LOWEST,
    MARGIN,
    SKETCH_SIZE,
    Facts,
    Sketch,
    literal_array,
    sketch_expressions,
    sketch_of,
    sketched_quantiles,
)

# Up to this many rows the built-in function's buffer is small whatever the values are.
SMALL_ROWS = 50_000
# Distinct values that may lie inside one group's brackets before the brackets are narrowed again.
BRACKET_ROWS = 2_000_000
# Columns per pass; their brackets are compiled into it.
COLUMNS_AT_ONCE = 32


def column_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float],
    rows: int | None = None,
    facts: Facts | None = None,
) -> dict[str, list[float]]:
    """Quantiles of named expressions over one frame, all columns in the same two passes.

    What is known of a column on the way (counts, brackets) is bounded by the schema, so
    it goes through the driver and back into the plan as literals. ``facts`` with sketches
    of the columns at the same probabilities spare the first pass.
    """
    probs, order = sorted(probs), list(values)
    if len(order) > COLUMNS_AT_ONCE:
        parts = [order[i : i + COLUMNS_AT_ONCE] for i in range(0, len(order), COLUMNS_AT_ONCE)]
        return {
            c: q
            for part in parts
            for c, q in column_quantiles(df, {c: values[c] for c in part}, probs, rows, facts).items()
        }
    if not order:
        return {}
    rows = facts.rows if facts and rows is None else rows
    wide = df.select(*[F.nanvl(values[c].cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(order)])
    out: dict[int, list] = {i: [None] * len(probs) for i in range(len(order))}
    if rows is None or rows > SMALL_ROWS:
        if facts and all(c in facts.sketches and facts.sketches[c].covers(probs) for c in order):
            counts = {i: facts.moments[c].n for i, c in enumerate(order)}
            sketches = {i: facts.sketches[c].at(probs) for i, c in enumerate(order)}
        else:
            counts, sketches = _sketch_columns(wide, list(out), probs, MARGIN)
        rows = max(counts.values())
    if rows <= SMALL_ROWS:
        out |= {k: q for k, q in aggregate_once(wide, {i: F.percentile(f"v{i}", probs) for i in out}).items() if q}
    else:
        out |= _exact_columns(wide, counts, sketches, probs, MARGIN, BRACKET_ROWS)
    return {c: list(out[i]) for i, c in enumerate(order)}


def _ranks(n, p):
    """Zero-based ranks on either side of the wanted position, and the share between them."""
    position = (n - 1) * p
    return math.floor(position), math.ceil(position), position - math.floor(position)


def _between(a, b, share):
    if a == b or share == 0:
        return a
    return a * (1 - share) + b * share if math.isinf(a) or math.isinf(b) else a + (b - a) * share


def _sketch_columns(wide, columns, probs, margin):
    """Non-null counts, and per column a Sketch."""
    exprs = {}
    for i in columns:
        exprs["n", i] = f"count(v{i})"
        exprs |= {(k, i): e for k, e in sketch_expressions(f"v{i}", probs, margin).items()}
    found = aggregate_once(wide, exprs)
    sketches = {i: sketch_of(found["at", i], found["distinct", i], probs, margin) for i in columns}
    return {i: found["n", i] for i in columns}, sketches


def _exact_columns(wide, counts, sketches: Mapping[int, Sketch], probs, margin, bracket_rows):
    out, todo = {}, [i for i, n in counts.items() if n]
    while todo:
        brackets = _narrow_columns(wide, counts, sketches, todo, probs, margin, bracket_rows)
        picked = _pick_columns(wide, counts, brackets, todo, probs)
        out |= {i: q for i, q in picked.items() if None not in q}
        todo = [i for i in todo if i not in out]
        if todo:
            margin *= 8
            sketches = dict(sketches) | _sketch_columns(wide, todo, probs, margin)[1]
    return out


def _narrow_columns(wide, counts, sketches, todo, probs, margin, bracket_rows):
    """Sketch again inside the brackets of columns where too many distinct values lie inside them.

    A bracket of one value holds one distinct value however many rows; a column of few values
    never has too many. Narrowing goes on as long as it gets anywhere.
    """
    brackets = {i: list(sketches[i].brackets) for i in todo}

    def share(i, rows):
        open_ = [n for n, (lo, hi) in zip(rows, brackets[i]) if lo != hi]
        return min(sum(open_), sketches[i].distinct)

    inside = {i: share(i, [counts[i] * 2 * margin] * len(probs)) for i in todo}
    steps = round(1 / min(margin, 0.5))
    grid = literal_array(s / steps for s in range(steps + 1))
    wide_ones = [i for i in todo if inside[i] > bracket_rows]
    while wide_ones:
        exprs = {}
        for i in wide_ones:
            for j, (lo, hi) in enumerate(brackets[i]):
                inner = f"v{i} >= {literal(lo)} and v{i} <= {literal(hi)}"
                kept = f"if({inner}, v{i}, null)"
                exprs["below", i, j], exprs["in", i, j] = f"count_if(v{i} < {literal(lo)})", f"count_if({inner})"
                exprs["at", i, j] = sketched_quantiles(kept, grid)
        found = aggregate_once(wide, exprs)
        before = dict(inside)
        for i in wide_ones:
            fresh = []
            for j, p in enumerate(probs):
                first, last, _share = _ranks(counts[i], p)
                below, n, at = found["below", i, j], found["in", i, j], found["at", i, j]
                lo, hi = brackets[i][j]
                if not below <= first <= last < below + n:
                    fresh.append((LOWEST, HIGHEST))
                    continue
                left = math.floor((first - below) / max(n - 1, 1) * steps) - 1
                right = math.ceil((last - below) / max(n - 1, 1) * steps) + 1
                fresh.append((lo if left < 0 else at[left], hi if right > steps else at[right]))
            brackets[i] = fresh
            inside[i] = share(i, [found["in", i, j] * 3 * margin for j in range(len(probs))])
        wide_ones = [i for i in wide_ones if bracket_rows < inside[i] < before[i]]
    return brackets


def _pick_columns(wide, counts, brackets, todo, probs):
    """Exact ranks from distinct values inside brackets and row counts between them.

    A value inside a bracket stands for itself, any other for the bracket end just below it.
    """
    pairs = ", ".join(f"{k}, v{i}" for k, i in enumerate(todo))
    long = wide.selectExpr(f"stack({len(todo)}, {pairs}) as (k, v)").filter("v is not null")
    # Brackets are looked up in literal arrays: spelled out per column, the compiled code
    # grows past what the JVM optimises.
    long = long.selectExpr(
        "k",
        "v",
        *[
            f"get({literal_array(brackets[i][j][e] for i in todo)}, k) as {name}{j}"
            for j in range(len(probs))
            for e, name in enumerate(("lo", "hi"))
        ],
    )
    within = " or ".join(f"(v >= lo{j} and v <= hi{j})" for j in range(len(probs)))
    below = ", ".join(f"if(v > hi{j}, hi{j}, double('-inf'))" for j in range(len(probs)))
    counted = (
        long.selectExpr("k", f"not ({within}) as gap", "v", f"greatest(double('-inf'), {below}) as below")
        .selectExpr("k", "gap", "if(gap, below, v) as at")
        .groupBy("k", "at", "gap")
        .agg(F.count("*").alias("rows"))
    )
    running = Window.partitionBy("k").orderBy("at", "gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("rows").over(running)).filter("not gap")
    picks = []
    for p in probs:
        for end in (0, 1):
            rank = f"get(array({', '.join(f'{_ranks(counts[i], p)[end]}L' for i in todo)}), k)"
            picks.append(F.expr(f"max(if(upto - rows <= {rank} and {rank} < upto, at, null))"))
    out = {}
    for row in ranked.groupBy("k").agg(*picks).collect():
        i, ends = todo[row["k"]], row[1:]
        out[i] = [
            None if None in (a, b) else _between(a, b, _ranks(counts[i], p)[2])
            for p, a, b in zip(probs, ends[::2], ends[1::2])
        ]
    return out


def grouped_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], total: int | None = None
) -> DataFrame:
    """One row per group: the keys, ``n`` non-null values, ``q`` array of quantiles."""
    probs = sorted(probs)
    if (rows.count() if total is None else total) <= SMALL_ROWS:
        v = F.nanvl(column(value).cast("double"), F.lit(None))
        return (
            rows.groupBy(*[column(k) for k in keys])
            .agg(F.count(v).alias("n"), F.percentile(v, probs).alias("q"))
            .filter("n > 0")
        )
    return _sketched(rows, keys, value, probs)


def _sketched(rows, keys, value, probs, margin=MARGIN, bracket_rows=BRACKET_ROWS) -> DataFrame:
    """The same in passes over groups of any number: what is known of them stays a frame."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = rows.select(
        *[column(k).alias(n) for k, n in zip(keys, names)], column(value).cast("double").alias("v")
    ).filter("v is not null and not isnan(v)")
    found = None
    while True:
        brackets = _narrowed(rows, names, probs, _first_brackets(rows, names, probs, margin), margin, bracket_rows)
        sizes = group_sizes(brackets, names)
        picked = materialise(_picked(rows, names, probs, brackets, sizes))
        complete = ~F.exists("q", lambda x: x.isNull())
        done = picked.filter(complete)
        found = done if found is None else found.unionByName(done)
        missed = picked.filter(~complete).select(*names, "n")
        if missed.isEmpty():
            return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", "q")
        rows = join_group_stats(rows, missed, names, "n").drop("n")
        margin *= 8


def _first_brackets(rows, names, probs, margin):
    ranks = [p - margin for p in probs] + [p + margin for p in probs]
    asked = [r for r in ranks if 0 < r < 1] or [0.5]
    sketched = (
        rows.groupBy(*names)
        .agg(
            F.count("v").alias("n"),
            F.approx_count_distinct("v").alias("distinct"),
            F.kll_sketch_agg_double("v", F.lit(SKETCH_SIZE)).alias("sketch"),
        )
        .withColumn("at", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, asked))))
    )
    bounds = [
        F.lit(LOWEST) if r <= 0 else F.lit(HIGHEST) if r >= 1 else F.get("at", F.lit(asked.index(r))) for r in ranks
    ]
    names_of_bounds = [f"lo{i}" for i in range(len(probs))] + [f"hi{i}" for i in range(len(probs))]
    return materialise(sketched.select(*names, "n", "distinct", *[b.alias(a) for b, a in zip(bounds, names_of_bounds)]))


def _around(p):
    """Zero-based ranks on either side of the wanted position, and the share between them."""
    position = (F.col("n") - 1) * F.lit(float(p))
    return F.floor(position), F.ceil(position), position - F.floor(position)


def _narrowed(rows, names, probs, brackets, margin, bracket_rows):
    """Sketch again inside the brackets of groups where too many distinct values lie inside them, while that gets anywhere."""
    ends = range(len(probs))
    steps = round(1 / min(margin, 0.5))
    grid = literal_array(s / steps for s in range(steps + 1))
    bounds = [f"{end}{i}" for i in ends for end in ("lo", "hi")]

    def held(rows_inside):
        open_ = sum((F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), 0).otherwise(rows_inside(i)) for i in ends), F.lit(0.0))
        return F.least(open_, F.col("distinct").cast("double"))

    brackets = brackets.withColumn("inside", held(lambda i: F.col("n") * (2.0 * margin))).withColumn("before", F.lit(HIGHEST))
    while True:
        too_many = (F.col("inside") > bracket_rows) & (F.col("inside") < F.col("before"))
        wide = brackets.filter(too_many)
        if wide.isEmpty():
            break
        joined = join_group_stats(rows, wide, names, "n")
        aggs = []
        for i in range(len(probs)):
            kept = f"if(v >= lo{i} and v <= hi{i}, v, null)"
            aggs += [
                F.expr(f"count_if(v < lo{i}) as below{i}"),
                F.expr(f"count({kept}) as in{i}"),
                F.expr(f"{sketched_quantiles(kept, grid)} as at{i}"),
            ]
        sketched = joined.groupBy(*names, "n", "distinct", "inside", *bounds).agg(*aggs)
        fresh = []
        for i, p in enumerate(probs):
            first, last, _share = _around(p)
            hit = (F.col(f"below{i}") <= first) & (last < F.col(f"below{i}") + F.col(f"in{i}"))
            span = F.greatest(F.col(f"in{i}") - 1, F.lit(1))
            left = F.floor((first - F.col(f"below{i}")) / span * steps).cast("int") - 1
            right = F.ceil((last - F.col(f"below{i}")) / span * steps).cast("int") + 1
            fresh += [
                F.when(~hit, LOWEST).when(left < 0, F.col(f"lo{i}")).otherwise(F.get(f"at{i}", left)).alias(f"lo{i}"),
                F.when(~hit, HIGHEST)
                .when(right > steps, F.col(f"hi{i}"))
                .otherwise(F.get(f"at{i}", right))
                .alias(f"hi{i}"),
            ]
        kept = [F.col(f"in{i}").alias(f"in{i}") for i in ends]
        sketched = sketched.select(*names, "n", "distinct", F.col("inside").alias("before"), *fresh, *kept)
        sketched = sketched.withColumn("inside", held(lambda i: F.col(f"in{i}") * (3.0 * margin))).drop(*[f"in{i}" for i in ends])
        brackets = materialise(brackets.filter(~too_many).unionByName(sketched))
    return brackets.select(*names, "n", *bounds)


def _picked(rows, names, probs, brackets, sizes):
    """Exact ranks from distinct values inside brackets and row counts between them."""
    ends = range(len(probs))
    within = " or ".join(f"(v >= lo{i} and v <= hi{i})" for i in ends)
    passed = " + ".join(f"int(v > hi{i})" for i in ends)
    counted = (
        join_group_stats(rows, brackets, names, "n", sizes)
        .selectExpr(*names, "n", "v", f"{within} as within", f"{passed} as passed")
        .groupBy(*names, "n", F.expr("if(within, v, null)").alias("kept"), F.expr("if(within, null, passed)").alias("gap"))
        .agg(F.count("*").alias("rows"), F.min("v").alias("first"))
    )
    running = Window.partitionBy(*names).orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("rows").over(running))
    picks = []
    for i, p in enumerate(probs):
        for end, side in zip("ab", ("floor", "ceil")):
            rank = f"{side}((n - 1) * {float(p)!r}D)"
            picks.append(f"max(if(upto - rows <= {rank} and {rank} < upto, kept, null)) as {end}{i}")
    grouped = ranked.groupBy(*names, "n").agg(*[F.expr(x) for x in picks])
    share = [f"((n - 1) * {float(p)!r}D - floor((n - 1) * {float(p)!r}D))" for p in probs]
    far = "(abs(a{0}) = double('inf') or abs(b{0}) = double('inf'))"
    quantiles = ", ".join(
        f"case when a{i} = b{i} or {share[i]} = 0 then a{i} when {far.format(i)} then a{i} * (1 - {share[i]}) + b{i} * {share[i]} else a{i} + (b{i} - a{i}) * {share[i]} end"
        for i in ends
    )
    return grouped.selectExpr(*names, "n", f"array({quantiles}) as q")
