"""Average ranks of whole columns, and the rank correlation built on them.

Ranks need a running total over all values in order. Values are counted first, then cut
into slices by a range exchange: totals run inside each slice, and the slice totals, one row each,
are added on top. No task sees more than one slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import (
    HOT_SHARE,
    GroupSizes,
    aggregate_once,
    column,
    discard,
    group_sizes,
    join_group_stats,
    materialise_table,
    nan_to_null,
    numeric_columns,
    small_frame,
    table_path,
)
from .frequencies import as_text, distinct_counts
from .moments import Facts, Moments
from .summary import correlations
from .validate import count_missing

# Values per slice aimed at.
SLICE_ROWS = 1_000_000
# Ranks (two numbers each) that may be broadcast.
BROADCAST_RANKS = 1_000_000
# Ranks of columns with gaps (one for each value and each column beside it) that may be broadcast.
RANK_NUMBERS = 1 << 23
# Columns of many values and without gaps up to which rows are sorted by each: a row carries a rank for each partner that is still to come.
SORTED = 8
# Tasks that share the rows of a slice where rows themselves are sorted.
SLICE_PARTS = 4


def average_ranks(df: DataFrame, name: str, slice_rows: int = SLICE_ROWS, rows: int | None = None) -> DataFrame:
    """``(value, n, rank)`` for each distinct non-null value; equal values share their mean rank."""
    value = column(name).cast("double") + F.lit(0.0)
    present = df.select(F.lit(0).alias("slot"), value.alias("value")).filter("value is not null")
    counts = present.groupBy("slot", "value").agg(F.count("*").alias("n"))
    return ranks_by_slot(counts, present.count() if rows is None else rows, slice_rows).select("value", "n", "rank")


def ranks_by_slot(counts: DataFrame, rows: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(slot, value, n, rank, middle)`` of counted values of many slots at once; ``middle`` is the slot's mean rank.

    One range exchange over (slot, value) cuts all slots into slices together. Totals run inside a slot's part of a slice, and
    the parts' totals, at most one row per slot and slice, are added on top.
    """
    slices = max(1, -(-rows // slice_rows))
    if slices > 1:
        ranged = counts.repartitionByRange(slices, "slot", "value")
        counts = materialise_table(ranged.withColumn("slice", F.spark_partition_id()))
    else:
        counts = counts.withColumn("slice", F.lit(0))
    within = Window.partitionBy("slot", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("n").over(within))
    totals = counts.groupBy("slot", "slice").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("slot").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("total").over(Window.partitionBy("slot"))
    offset = totals.select("slot", "slice", (F.sum("total").over(before) - F.col("total")).alias("base"), ((whole + 1) / 2.0).alias("middle"))
    ranked = ranked.join(F.broadcast(offset), ["slot", "slice"])
    mean_rank = F.col("upto") + F.col("base") - (F.col("n") - 1) / 2.0
    return ranked.select("slot", "value", "n", mean_rank.alias("rank"), "middle")


def spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D7. Rank correlation ``(x, y, r)`` of every pair; ranks are over the rows where both are present.

    All pairs are ranked together, each over its own rows, which are sorted once per column of many values. Only where more than SORTED such
    columns have no gaps, columns without gaps share their ranks, and rows are joined to these. Jobs depend neither on the pairs nor, while ranks can be broadcast, on the columns.
    """
    df = nan_to_null(df)
    names = numeric_columns(df) if columns is None else list(columns)
    rows, missing = count_missing(df.select(*[column(c) for c in names]))
    whole = [c for c in names if not missing[c]]
    values = df.select(*[(column(c).cast("double") + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(names)])
    small = _few_valued(values) if rows else list(range(len(names)))
    joined = whole if sum(names.index(c) not in small for c in whole) > SORTED else []
    found = _rank_correlations(df, joined, rows) if joined else {}
    rest = [(a, b) for i, a in enumerate(names) for b in names[: i + 1] if a not in joined or b not in joined]
    if rest:
        for (a, b), r in zip(rest, _sorted_correlations(values, names, rest, rows, small)):
            found[a, b] = found[b, a] = r
    return small_frame(df.sparkSession, [(a, b, found[a, b]) for a in names for b in names], "x string, y string, r double")


def _pair_cells(values: DataFrame, names: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(p, a, b, n)``: how often two values occur together in the rows where both are present, for all pairs in one count.

    ``values`` holds one array column ``v`` with the values of the names.
    """
    index = {c: i for i, c in enumerate(names)}
    sides = [F.array(*[F.lit(index[pair[k]]) for pair in pairs]) for k in (0, 1)]
    both = F.arrays_zip(F.sequence(F.lit(0), F.lit(len(pairs) - 1)).alias("p"), sides[0].alias("i"), sides[1].alias("j"))
    met = values.select("v", F.inline(both).alias("p", "i", "j"))
    met = met.select("p", F.get("v", F.col("i")).alias("a"), F.get("v", F.col("j")).alias("b")).filter("a is not null and b is not null")
    return materialise_table(met.groupBy("p", "a", "b").agg(F.count("*").alias("n")))


def _side_counts(cells: DataFrame) -> DataFrame:
    """``(slot, value, n, cells)``: the margins of all pairs; slots 2 p and 2 p + 1 are a pair's two sides."""
    sides = F.array(F.struct((2 * F.col("p")).alias("slot"), F.col("a").alias("value")), F.struct((2 * F.col("p") + 1).alias("slot"), F.col("b").alias("value")))
    long = cells.select(F.inline(sides).alias("slot", "value"), "n")
    return long.groupBy("slot", "value").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))


def _with_sides(cells: DataFrame, margins: DataFrame, measure: str) -> DataFrame:
    """Cells with a measure of their two margins, as ``ma`` and ``mb``."""
    margins = margins.select("slot", "value", "cells", measure)
    sizes = group_sizes(margins, ["slot", "value"], "cells")
    for k, side in enumerate("ab"):
        keyed = cells.withColumns({"slot": 2 * F.col("p") + k, "value": F.col(side)})
        cells = join_group_stats(keyed, margins, ["slot", "value"], "cells", sizes).withColumnRenamed(measure, f"m{side}").drop("slot", "value", "cells")
    return cells


def _few_valued(values: DataFrame) -> list[int]:
    """Which of the columns v0, v1, ... have so few values that their ranks beside every column may be broadcast."""
    width = len(values.columns)
    estimates = aggregate_once(values, {i: F.approx_count_distinct(f"v{i}", 0.02) for i in range(width)})
    small, room = [], RANK_NUMBERS
    for i in sorted(estimates, key=lambda i: (estimates[i], i)):
        room -= int(1.1 * estimates[i] + 1) * width
        if room < 0:
            break
        small.append(i)
    return small


def _sorted_correlations(values: DataFrame, names: Sequence[str], pairs: Sequence[tuple[str, str]], rows: int, small: Sequence[int]) -> list[float | None]:
    """Rank correlations of pairs from a table of ranks per column instead of cells per pair.

    A value's rank beside another column counts the rows where that one is present, so a value has one rank for each name. Columns of few
    values (``small``) are looked up in a broadcast table (at most RANK_NUMBERS ranks in all). The others are sorted one after the other: a row
    carries its ranks only until the partner's turn, when their product is added up. So a row is shuffled once per such column, not per pair.
    """
    wanted = [(names.index(a), names.index(b)) for a, b in pairs]
    large = [i for i in range(len(names)) if i not in small]
    sums = PairSums({}, {}, {})
    tables = {i: RankTable.build(*x) for i, x in _counts_beside(values, small).items()}
    for i, t in tables.items():
        sums.spread.update({(i, j): t.spread[j] for j in range(len(names))})
        sums.several.update({(i, j): bool(t.several[j]) for j in range(len(names))})
    _add_small_products(values, tables, wanted, sums)
    if large:
        _add_large_products(values, tables, large, rows, sums)
    out = []
    for i, j in wanted:
        # One distinct value makes a constant column.
        varied = sums.several.get((i, j)) and sums.several.get((j, i))
        product = sums.spread[i, i] if i == j and varied else sums.product.get((i, j), sums.product.get((j, i), 0.0))
        out.append(float(product / (sums.spread[i, j] * sums.spread[j, i]) ** 0.5) if varied else None)
    return out


class PairSums(NamedTuple):
    """By (column, partner), over the rows where both are present; ranks are less their mean."""

    product: dict[tuple[int, int], float]
    spread: dict[tuple[int, int], float]  # sum of the column's squared ranks
    several: dict[tuple[int, int], bool]  # whether the column has more than one value


class RankTable(NamedTuple):
    """A column's sorted values, and by value and partner: rows where both are present, and the rank less its mean."""

    values: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    spread: np.ndarray
    several: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray) -> RankTable:
        sort = np.argsort(values)
        values, counts = values[sort], counts[sort]
        ranks = np.cumsum(counts, 0) - (counts - 1) / 2.0 - (counts.sum(0) + 1) / 2.0
        return cls(values, counts, ranks, (counts * ranks * ranks).sum(0), (counts > 0).sum(0) > 1)

    def beside(self, x: np.ndarray, partner: int) -> np.ndarray:
        """Ranks of values (NaN: absent, rank 0)."""
        out = np.zeros(len(x))
        some = ~np.isnan(x)
        out[some] = self.ranks[np.searchsorted(self.values, x[some]), partner]
        return out


def _counts_beside(values: DataFrame, slots: Sequence[int], only: DataFrame | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By slot: its distinct values (of those in ``only``), and how often each occurs where each column is present."""
    width = len(values.columns)
    if not slots:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"v{i}").alias("value")) for i in slots])
    long = values.select(F.inline(cells).alias("slot", "value"), *values.columns).filter("value is not null")
    if only is not None:
        long = long.join(F.broadcast(only), ["slot", "value"], "left_semi")
    counts = [F.count(f"v{j}").alias(f"n{j}") for j in range(width)]
    found = long.groupBy("slot", "value").agg(*counts).toArrow()
    slot, value = found.column("slot").to_numpy(), found.column("value").to_numpy()
    n = np.column_stack([found.column(f"n{j}").to_numpy() for j in range(width)]) if len(slot) else np.empty((0, width), np.int64)
    return {i: (value[slot == i], n[slot == i]) for i in slots}


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of doubles side by side; NaN where absent."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


def _add_small_products(values: DataFrame, tables: dict[int, RankTable], pairs: Sequence[tuple[int, int]], sums: PairSums) -> None:
    pairs = [(i, j) for i, j in pairs if i in tables and j in tables and i != j]
    if not pairs:
        return
    shared = values.sparkSession.sparkContext.broadcast(tables)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tables = np.zeros(len(pairs)), shared.value
        for batch in batches:
            m = _matrix(batch)
            both = ~np.isnan(m)
            at = {i: np.searchsorted(t.values, np.where(both[:, i], m[:, i], t.values[0])) for i, t in tables.items() if len(t.values)}
            for p, (i, j) in enumerate(pairs):
                if i in at and j in at:
                    products = tables[i].ranks[at[i], j] * tables[j].ranks[at[j], i]
                    found[p] += products[both[:, i] & both[:, j]].sum()
        yield pa.record_batch([pa.array(np.arange(len(pairs))), pa.array(found)], names=["p", "s"])

    for p, s in values.mapInArrow(rows, "p long, s double").groupBy("p").agg(F.sum("s")).collect():
        sums.product[pairs[p]] = s


def _add_large_products(values: DataFrame, tables: dict[int, RankTable], large: Sequence[int], rows: int, sums: PairSums) -> None:
    """Products of all pairs with a column of ``large``, each of which is sorted in turn.

    Values that may make up more than 1 row in HOT_SHARE are told by the quantiles and counted beforehand. Rows of such a value may then lie in
    any slice. Slices rank their rows by themselves; the rows of the slices before, known afterwards, are added where ranks are used.
    """
    spark, width = values.sparkSession, len(values.columns)
    points = [k / HOT_SHARE for k in range(HOT_SHARE + 1)]
    quantiles = aggregate_once(values, {i: F.percentile_approx(f"v{i}", points, 10 * HOT_SHARE) for i in large})
    often = [(i, v) for i in large for v, w in zip(quantiles[i] or [], (quantiles[i] or [])[1:]) if v == w]
    often = spark.createDataFrame(list(dict.fromkeys(often)), "slot int, value double")
    hot = {i: RankTable.build(*x) for i, x in _counts_beside(values, large, often).items()}
    now, paths = values, []
    for at, x in enumerate(large):
        later, done = large[at + 1 :], large[:at]
        path = table_path(spark)
        found = materialise_table(_ranked_slices(now, tables, hot[x], x, later, done, often.filter(F.col("slot") == x).drop("slot"), rows), path)
        parts = found.filter("slice is not null and a is not null").select("slice", "a", "b", "n", "ties", "groups").orderBy("slice").collect()
        n = np.array([r["n"] for r in parts]).reshape(len(parts), width)
        total = n.sum(0) + hot[x].counts.sum(0)
        shift = np.cumsum(n, 0) - n - (total + 1) / 2.0
        ties = sum((np.array(r["ties"]) for r in parts), (hot[x].counts.astype(np.float64) ** 3 - hot[x].counts).sum(0))
        groups = sum((np.array(r["groups"]) for r in parts), (hot[x].counts > 0).sum(0))
        for j in range(width):
            sums.spread[x, j] = ((float(total[j]) ** 3 - float(total[j])) - float(ties[j])) / 12
            sums.several[x, j] = bool(groups[j] > 1)
        for j in [*tables, *done]:
            sums.product[x, j] = float(sum(r["a"][j] + s[j] * r["b"][j] for r, s in zip(parts, shift)))
        if not later:
            break
        offsets = small_frame(spark, [(r["slice"], *map(float, s[later])) for r, s in zip(parts, shift)], ", ".join(["slice int", *(f"o{k} double" for k in later)]))
        carried = found.filter("a is null").join(F.broadcast(offsets), "slice", "left")
        kept = [c for c in found.columns if c[0] in "vr" and c not in {f"r{x}_{k}" for k in later}]
        now = carried.select(*kept, *[(F.col(f"r{x}_{k}") + F.col(f"o{k}")).alias(f"r{x}_{k}") for k in later])
        paths.append(path)
        if len(paths) > 1:
            discard(spark, paths.pop(0))
    for path in [*paths, path]:
        discard(spark, path)


def _ranked_slices(
    now: DataFrame, tables: dict[int, RankTable], hot: RankTable, x: int, later: Sequence[int], done: Sequence[int], often: DataFrame, rows: int
) -> DataFrame:
    """One row per slice with its sums, and every row without column x, with its ranks in x beside the later columns.

    ``now`` has v<k>, the values of columns not yet ranked, and r<j>_<k>, the rank in j beside a column k not yet ranked, less its mean.
    """
    width = len(tables) + len(later) + len(done) + 1
    kept = [c for c in now.columns if c != f"v{x}" and not c.endswith(f"_{x}")]
    new = [f"r{x}_{k}" for k in later]
    # What tells whether a column is present.
    sides = {k: f"v{k}" for k in [*tables, *later, x]} | {j: f"r{j}_{x}" for j in done}
    order = now.columns
    place = {k: order.index(c) for k, c in sides.items()}
    present = now.filter(f"v{x} is not null").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    present = present.join(F.broadcast(often), F.col(f"v{x}") == F.col("value"), "left")
    present = present.withColumn("salt", F.when(F.col("value").isNotNull(), F.col("salt")).otherwise(0)).select(*order, "salt")
    slices = max(1, -(-rows // SLICE_ROWS)) * SLICE_PARTS
    ranged = present.repartitionByRange(slices, f"v{x}", "salt").sortWithinPartitions(f"v{x}").select(*order)
    shared = now.sparkSession.sparkContext.broadcast((tables, hot))
    sums_of = ("a", "b", "n", "ties", "groups")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, hot = shared.value
        part = TaskContext.get().partitionId()
        below = np.vstack((np.zeros((1, width)), np.cumsum(hot.counts, 0)))
        a, b, ties = np.zeros(width), np.zeros(width), np.zeros(width)
        n, groups = np.zeros(width, np.int64), np.zeros(width, np.int64)
        held = np.empty((0, len(order)))

        def ranked(m):
            own = m[:, place[x]]
            there = np.column_stack([~np.isnan(m[:, place[k]]) for k in range(width)])
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(own))))
            spot = np.searchsorted(hot.values, own[starts])
            known = np.zeros(len(starts), bool)
            inside = spot < len(hot.values)
            known[inside] = hot.values[spot[inside]] == own[starts][inside]
            counts = np.add.reduceat(there.astype(np.int64), starts, 0)
            counts[known] = 0
            size = counts.copy()
            size[known] = hot.counts[spot[known]]
            ranks = n + np.cumsum(counts, 0) - counts + below[spot] + (size + 1) / 2.0
            n[:] += counts.sum(0)
            ties[:] += (counts.astype(np.float64) ** 3 - counts).sum(0)
            groups[:] += (counts > 0).sum(0)
            ranks = ranks[group]
            for k in [*tables, *done]:
                other = tables[k].beside(np.where(there[:, k], m[:, place[k]], np.nan), x) if k in tables else np.where(there[:, k], m[:, place[k]], 0.0)
                a[k] += (ranks[:, k] * other).sum()
                b[k] += other.sum()
            if later:
                columns = [m[:, order.index(c)] for c in kept] + [np.where(there[:, k], ranks[:, k], np.nan) for k in later]
                for start in range(0, len(m), 1 << 14):
                    size = min(1 << 14, len(m) - start)
                    cells = [pa.array(c[start : start + size], from_pandas=True) for c in columns]
                    nothing = [pa.nulls(size, f.type) for f in schema_arrow[-len(sums_of) :]]
                    yield pa.record_batch([*cells, pa.array(np.full(size, part), pa.int32()), *nothing], schema=pa.schema(schema_arrow))

        kinds = [pa.list_(pa.float64())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        schema_arrow = [pa.field(c, pa.float64()) for c in [*kept, *new]] + [pa.field("slice", pa.int32())] + [pa.field(c, t) for c, t in zip(sums_of, kinds)]
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.vstack((held, _matrix(batch)))
            # The last value may go on in the next batch; one that is known to be frequent needn't be whole.
            last = m[-1, place[x]]
            spot = np.searchsorted(hot.values, last)
            whole = spot < len(hot.values) and hot.values[spot] == last
            cut = len(m) if whole else int(np.searchsorted(m[:, place[x]], last, "left"))
            if cut:
                yield from ranked(m[:cut])
            held = m[cut:]
        if len(held):
            yield from ranked(held)
        sums = [pa.array([v.tolist()], t) for v, t in zip((a, b, n, ties, groups), kinds)]
        yield pa.record_batch([*(pa.nulls(1, pa.float64()) for _ in [*kept, *new]), pa.array([part], pa.int32()), *sums], schema=pa.schema(schema_arrow))

    schema = [f"{c} double" for c in [*kept, *new]] + ["slice int", "a array<double>", "b array<double>", "n array<long>", "ties array<double>", "groups array<long>"]
    out = ranged.mapInArrow(rank, ", ".join(schema))
    if later:
        gap = now.filter(f"v{x} is null").select(*kept, *[F.lit(None).cast("double").alias(c) for c in new], F.lit(None).cast("int").alias("slice"))
        out = out.unionByName(gap, allowMissingColumns=True)
    return out


def _rank_correlations(df: DataFrame, names: Sequence[str], rows: int) -> dict[tuple[str, str], float | None]:
    """Rank correlations of columns without gaps in at most ``rows`` rows."""
    values = df.select(*[(column(c).cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(names)])
    stacked = ", ".join(f"{i}, x{i}" for i in range(len(names)))
    counts = values.selectExpr(f"stack({len(names)}, {stacked}) as (slot, value)").groupBy("slot", "value").agg(F.count("*").alias("n"))
    all_ranks = materialise_table(ranks_by_slot(counts, rows * len(names)).select("slot", "value", "n", "rank"))
    distinct = dict(all_ranks.groupBy("slot").agg(F.count("*")).collect())
    ranked, budget, moments = values, BROADCAST_RANKS, {}
    for i, c in enumerate(names):
        ranks = all_ranks.filter(F.col("slot") == i).select(F.col("value").alias(f"x{i}"), "n", F.col("rank").alias(f"r{i}"))
        groups = distinct.get(i, 0)
        # One distinct value makes a constant column; otherwise only the mean matters.
        moments[c] = Moments(rows, (rows + 1) / 2, None, 0.0, float(groups > 1))
        if groups <= budget:
            budget -= groups
            ranked = ranked.join(F.broadcast(ranks.drop("n")), f"x{i}", "left").drop(f"x{i}")
        else:
            ranked, budget = _joined(ranked, ranks, i, group_sizes(ranks, [f"x{i}"])), BROADCAST_RANKS
    facts = Facts(rows, {c: 0 for c in names}, moments)
    return correlations(ranked, expressions={c: F.col(f"r{i}") for i, c in enumerate(names)}, facts=facts)


def _joined(rows: DataFrame, ranks: DataFrame, i: int, sizes: GroupSizes) -> DataFrame:
    """Ranks too many to broadcast: rows meet them by a shuffle, those of hot values apart."""
    return materialise_table(join_group_stats(rows, ranks, [f"x{i}"], "n", sizes).drop("n", f"x{i}"))


# Bytes beyond which a category is told apart by its digest.
LONG_CATEGORY = 64


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D7. Association ``(x, y, v)`` of categorical pairs, from the cells that occur.

    The cells of all pairs are counted together, long texts by digest. A column without gaps and repeats needs no count: each of
    its values decides the other's, so v is 1 (NULL beside a column of one value).
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    facts = _distinct(df, columns) if pairs else {}
    found: dict[tuple[str, str], float | None] = {}
    for a, b in pairs:
        for one, other in ((a, b), (b, a)):
            if facts[one].key:
                found[a, b] = 1.0 if facts[other].distinct > 1 else None
    counted = [p for p in pairs if p not in found]
    if counted:
        names = [c for c in columns if any(c in p for p in counted)]
        cells = _pair_cells(df.select(F.array(*[_category(df, c) for c in names]).alias("v")), names, counted)
        margins = materialise_table(_side_counts(cells).withColumnRenamed("n", "m"))
        sizes = dict(margins.groupBy("slot").agg(F.count("*")).collect())
        share = F.sum(F.col("n") * F.col("n") / F.col("ma") / F.col("mb"))
        shares = dict(_with_sides(cells, margins, "m").groupBy("p").agg(share).collect())
        for p, pair in enumerate(counted):
            least = min(sizes.get(2 * p, 0), sizes.get(2 * p + 1, 0)) - 1
            found[pair] = max(0.0, (shares[p] - 1) / least) ** 0.5 if p in shares and least > 0 else None
    return small_frame(df.sparkSession, [(a, b, found[a, b]) for a, b in pairs], "x string, y string, v double")


def _category(df: DataFrame, name: str) -> Column:
    text = as_text(df, name)
    return F.when(F.octet_length(text) > LONG_CATEGORY, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(F.concat(F.lit("="), text))


class Distinct(NamedTuple):
    distinct: int
    # Whether every row has a value of its own.
    key: bool


def _distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, Distinct]:
    wide = df.select(*[column(c) for c in columns])
    rows, missing = count_missing(wide)
    counts = distinct_counts(wide)
    return {c: Distinct(counts[c][0], rows > 0 and not missing[c] and counts[c][0] == rows) for c in columns}
