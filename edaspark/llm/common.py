"""Helpers of this subpackage: rows with an identity, byte tables, connected components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialise_table

# Fixed value: white space between words, U+0020 and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
SPACES_TEXT = SPACES.decode()
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes.maketrans(CAPITALS.encode(), CAPITALS.lower().encode())


Kept = TypeVar("Kept")
# Tables that this worker process keeps between tasks.
_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], Kept]) -> Kept:
    """Tables of one operator stay in a worker process for its next task; those of another one are let go first."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Forget tables that the worker keeps, and give its free memory back, for operators that come after and keep none."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def sealed(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ..., so that no name clashes with ours; ``toDF`` gives names back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def at(df: DataFrame, name: str) -> Column:
    """The sealed column that stands for a name."""
    return F.col(f"c{df.columns.index(name)}")


def identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(_row, _id, _text, _digest) of every row.

    _row tells rows apart even where ids are null or repeated, within one plan; rows of
    equal id and _digest (of the text) are alike, in any plan.
    """
    text = at(docs, text_column).cast("string")
    return sealed(docs).select(
        F.monotonically_increasing_id().alias("_row"), at(docs, id_column).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_digest")
    )


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, CAPITALS, CAPITALS.lower())


def fold_of(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def majority_bits(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of 64-bit hashes: a bit is 1 if set in more than half of them."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


class Table:
    """Longs to places in sorted order, by open addressing; -1 for those absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.places = np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slots(keys[left], step)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            placed = free & (self.keys[slot] == keys[left])
            self.places[slot[placed]] = left[placed]
            left, step = left[~placed], step + 1

    def _slots(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (mixed + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys, 0)
        held = self.keys[slot]
        out = np.where(held == keys, self.places[slot], -1)
        left, step = np.flatnonzero((held != keys) & (held != -1)), 1
        while len(left):
            slot = self._slots(keys[left], step)
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            left, step = left[~hit & (held != -1)], step + 1
        return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes on edges (a, b) of longs; root is the smallest node reachable.

    Alternates pulling every neighbour, then every smaller neighbour, to a node's smallest one,
    which halves distances, so rounds grow with the logarithm of the longest chain. Each round is
    two aggregates with joins over the edges, and is written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, mark = _kept(now)
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        now = both.join(least, both.a == least.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = now.filter("a <> b").distinct()  # (v, smallest around u) for every neighbour v above u
        # Every node's pairs now point down; all of them and the node go to the smallest.
        least = now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        now = now.join(least, now.a == least.u)
        now = now.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = now.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
        before, (now, mark) = mark, _kept(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = materialise_table(edges)
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, tuple(mark)
