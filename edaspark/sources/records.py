"""Records of comma-separated text whose quoted cells hold line breaks, from files that are read in splits.

A reader that meets a line either is inside quotes or is not, and a line leads from each of the two states to one of them: most
lines keep the state (SAME), a line with an odd quote changes it (TURN), and one with quotes inside bare
cells may end outside (SHUT) or inside (OPEN) whatever came before. These maps compose, so every split reports the map of its
lines, a scan over a file's splits (one row each) tells the state in which each split starts, and a second pass cuts the
records of every split by itself. What a split leaves open goes to where it is closed: at most two pieces a split are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import BROADCAST_ROWS, materialise

SAME, TURN, SHUT, OPEN = range(4)
WHOLE, TAIL, HEAD = range(3)

_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+'
_UNCLOSED = r'"(?:[^"]++|"")*+$'
# A line that leaves a quote open: from outside, and from inside of one.
FROM_OUTSIDE = rf"^(?:{_CELL},)*+{_UNCLOSED}"
FROM_INSIDE = rf'^(?:[^"]++|"")*+(?:$|"[^,]*+,(?:{_CELL},)*+{_UNCLOSED})'


def _turn(value: Column) -> Column:
    outside, inside = value.rlike(FROM_OUTSIDE), value.rlike(FROM_INSIDE)
    turn = F.when(outside, F.when(inside, OPEN).otherwise(TURN)).otherwise(F.when(inside, SAME).otherwise(SHUT))
    return F.when(F.instr(value, '"') == 0, SAME).otherwise(turn).cast("byte")


def quoted_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block: where the line's split starts, line: grows within a split, turn) of all lines."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        _turn(F.col("value")).alias("turn"),
    )


def _after(inside: Column, turn: Column) -> Column:
    """The state behind a line."""
    return F.when(turn == SAME, inside).when(turn == TURN, ~inside).otherwise(turn == OPEN)


def _split_states(lines: DataFrame) -> DataFrame:
    """(file, block, open: whether the split starts inside quotes, after: whether it ends so), one row a split."""
    turns = F.array_sort(F.collect_list(F.when(F.col("turn") != SAME, F.struct("line", "turn"))))
    splits = lines.groupBy("file", "block").agg(turns.alias("turns"))
    last = lambda start: F.aggregate("turns", F.lit(start), lambda state, t: _after(state, t["turn"]))
    outside, inside = last(False), last(True)
    turn = F.when(outside, F.when(inside, OPEN).otherwise(TURN)).otherwise(F.when(inside, SAME).otherwise(SHUT))
    splits = splits.select("file", "block", turn.alias("turn"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("turned", F.count_if(F.col("turn") == TURN).over(order))
    fixed = F.last(F.when(F.col("turn") >= SHUT, F.struct("turn", "turned")), ignorenulls=True).over(order)
    splits = splits.withColumn("fixed", fixed)
    since = F.col("turned") - F.coalesce("fixed.turned", F.lit(0))
    after = F.coalesce(F.col("fixed.turn") == OPEN, F.lit(False)) != (since % 2 == 1)
    splits = splits.withColumn("after", after)
    before = F.lag("after", 1, False).over(Window.partitionBy("file").orderBy("block"))
    return splits.select("file", "block", before.alias("open"), "after")


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Lines from each start to the next (the last one closes) as one text each."""
    if len(starts) == len(lines) + 1:
        return lines
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines)
    return pc.binary_join(lists, "\n")


class _Splitter:
    """Cuts the lines of one split, which come in order, into records and pieces."""

    def __init__(self, inside: bool, top: bool):
        self.inside, self.kind, self.top = inside, HEAD if inside else WHOLE, top
        self.pending: list[str] = []

    def take(self, lines: pa.Array, turns: np.ndarray) -> Iterator[tuple[pa.Array, int, bool]]:
        """(texts, kind, whether the first begins the file)."""
        fixed = turns >= SHUT
        place = np.maximum.accumulate(np.where(fixed, np.arange(len(turns)), -1))
        turned = np.cumsum(turns == TURN)
        base = np.where(place < 0, self.inside, turns[place] == OPEN)
        after = base ^ ((turned - np.where(place < 0, 0, turned[place])) % 2 == 1)
        before = np.append(self.inside, after[:-1])
        starts = np.flatnonzero(~before)
        self.inside = bool(after[-1])
        if not len(starts):
            self.pending += lines.to_pylist()
            return
        if self.pending or starts[0]:
            yield pa.array(["\n".join([*self.pending, *lines[: starts[0]].to_pylist()])]), self.kind, self._top()
            self.pending = []
        self.kind = WHOLE
        end = len(lines)
        if self.inside:
            end = int(starts[-1])
            self.pending = lines[end:].to_pylist()
        if end:
            bounds = np.append(starts[starts < end], end)
            if len(bounds) > 1:
                yield _joined(lines[bounds[0] : end], bounds - bounds[0]), WHOLE, self._top()

    def _top(self) -> bool:
        top, self.top = self.top, False
        return top

    def close(self) -> Iterator[tuple[pa.Array, int, bool]]:
        if self.pending:
            yield pa.array(["\n".join(self.pending)]), TAIL if self.kind == WHOLE else HEAD, self._top()


def csv_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, value, first: whether it is the file's first) of every record, line breaks in quotes included."""
    lines = quoted_lines(spark, files)
    splits = materialise(_split_states(lines))
    unclosed = splits.groupBy("file").agg(F.max_by("after", "block").alias("after")).filter("after").agg(F.min("file")).first()[0]
    if unclosed is not None:
        raise ValueError(f"Unbalanced quotes in {unclosed}")
    opened = splits.filter("open").select("file", "block", "open")
    few = opened.count() <= BROADCAST_ROWS
    lines = lines.join(F.broadcast(opened) if few else opened, ["file", "block"], "left")
    if not few:
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "block", "line")
    lines = lines.select("value", "turn", "file", "block", F.coalesce("open", F.lit(False)).alias("open"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = splitter = None

        def out(texts: pa.Array, kind: int, first: bool) -> pa.RecordBatch:
            n = len(texts)
            firsts = np.zeros(n, bool)
            firsts[0] = first
            return pa.record_batch(
                [texts.cast(pa.string()), pa.array([key[0]] * n), pa.array(np.full(n, key[1])), pa.array(np.full(n, kind, np.int8)), pa.array(firsts)],
                ["value", "file", "block", "kind", "first"],
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names, blocks = batch.column(2).dictionary_encode(), batch.column(3).to_numpy()
            codes = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1).tolist(), n]
            turns = batch.column(1).to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                own = (names.dictionary[int(codes[a])].as_py(), int(blocks[a]))
                if own != key:
                    if splitter:
                        yield from (out(*x) for x in splitter.close())
                    key, splitter = own, _Splitter(batch.column(4)[a].as_py(), own[1] == 0)
                yield from (out(*x) for x in splitter.take(batch.column(0).slice(a, b - a), turns[a:b]))
        if splitter:
            yield from (out(*x) for x in splitter.close())

    cut = lines.mapInArrow(rows, "value string, file string, block long, kind byte, first boolean")
    pieces = cut.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("record", F.count_if(F.col("kind") == TAIL).over(order)).groupBy("file", "record")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("turn"), "value"))), lambda p: p["value"]), "\n")
    pieces = pieces.agg(text.alias("value"), F.bool_or("first").alias("first"))
    return cut.filter(F.col("kind") == WHOLE).select("file", "value", "first").unionByName(pieces.select("file", "value", "first"))
