"""Near-duplicates by SimHash, found through anchors of a covering code.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most one bit of the first
31 or of the next 31. In each such block the anchors are the words of the perfect Hamming
code [31, 26]: each block lies within covering radius 1 of exactly one anchor, its home. A
fingerprint is replicated to all anchors within radius 1 plus threshold 1 (16 at most), so of two
linked fingerprints each visits the other's home. At an anchor, homes are compared with all visitors.

Distinct fingerprints only are compared. Anchors that are home to many are split: each part of
its homes meets all visitors. What leaves an anchor is a forest over linked fingerprints, not their
pairs; components of all forests are found by Spark.

A bit is 1 if set in more than half of the hashes (XXH64, seed 42) of the text's word shingles,
repeats included. Fewer words than a shingle make one shingle; no word at all (null, empty, blank)
makes fingerprint 0, which is linked like any other. A null id takes part, but names a component
only if the component has no other. Repeated rows are returned each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise_table
from .common import LOWER, at, components, identified, majority_bits, sealed
from .near_copies import SHINGLE, SIMILARITY, near_copies

SEED = 42
BLOCK = 31
THRESHOLD = 3
# Homes of an anchor that one task holds; those of a fuller one are split.
HOMES = 4096
# Visitors held before they are compared, and pairs compared at a time (some ten arrays of them, 2 MB each).
HELD, PAIRS = 1 << 20, 1 << 18


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    return majority_bits(h)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(_id, _digest, fp) of every row; fp is the fingerprint as a signed long."""
    texts = identified(docs, id_column, text_column).select("_id", "_digest", "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"", shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*batch.columns[:2], pa.array(np.array(prints, np.uint64).view(np.int64))], names=["_id", "_digest", "fp"])

    return texts.mapInArrow(rows, texts.select("_id", "_digest").withColumn("fp", F.lit(0).cast("long")).schema)


def _flips() -> np.ndarray:
    """By syndrome: what to flip for each code word within distance 2; the home comes first.

    Bit p of a block counts as position p + 1, and the syndrome is the exclusive or of the set
    positions. Flipping positions i and j with i ^ j = s clears syndrome s.
    """
    table = np.zeros((BLOCK + 1, 16), np.uint64)
    for s in range(1, BLOCK + 1):
        pairs = [(i, i ^ s) for i in range(1, BLOCK + 1) if i < i ^ s]
        table[s] = [1 << (s - 1), *[(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]]
    return table


FLIPS = _flips()


def anchors_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, index of the fingerprint, whether it is its home; for both blocks of each fingerprint."""
    keys, rows, homes = [], [], []
    for block in range(2):
        x = (prints >> np.uint64(BLOCK * block)) & np.uint64((1 << BLOCK) - 1)
        syndrome = np.zeros(len(x), np.int64)
        for p in range(BLOCK):
            syndrome ^= np.where((x >> np.uint64(p)) & np.uint64(1), p + 1, 0)
        near = (x[:, None] ^ FLIPS[syndrome]) | np.uint64(block << BLOCK)
        real = np.ones(near.shape, bool)
        real[syndrome == 0, 1:] = False  # a code word has no other within distance 2
        first = np.zeros(near.shape, bool)
        first[:, 0] = True
        row = np.broadcast_to(np.arange(len(x))[:, None], near.shape)
        keys.append(near[real]), rows.append(row[real]), homes.append(first[real])
    return np.concatenate(keys).view(np.int64), np.concatenate(rows), np.concatenate(homes)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) over the given links, for nodes that aren't the smallest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _links(key: np.ndarray, part: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints (node, root) of whole groups of equal (key, part); these are sorted, homes first."""
    bounds = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True])))
    size = np.diff(bounds)
    homes = np.add.reduceat(home.astype(np.int64), bounds[:-1])
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    work = np.where(size > 1, homes, 0)
    todo = np.flatnonzero(work)
    # All (home, member) pairs of the group are compared, some groups at a time; of a large group, some homes.
    firsts = np.repeat(bounds[todo], work[todo])
    at = np.arange(len(firsts)) - np.repeat(np.cumsum(work[todo]) - work[todo], work[todo])
    home_row, group_start, group_size = firsts + at, firsts, np.repeat(size[todo], work[todo])
    ends = np.cumsum(group_size)
    start = 0
    while start < len(home_row):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = group_size[start:stop]
        left = np.repeat(home_row[start:stop], n)
        right = np.repeat(group_start[start:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = fp[left], fp[right]
        near = (np.bitwise_count((x ^ y).view(np.uint64)) <= THRESHOLD) & (x != y)
        if near.any():
            found.append(_forest(x[near], y[near]))
        start = stop
    return _forest(*map(np.concatenate, zip(*found)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted (key, part, home, fp) rows; a group is held to its end, or beyond HELD rows its homes only."""
    held = None
    empty = lambda x: x is None or not len(x[0])

    def out(links):
        return pa.record_batch([pa.array(links[0]), pa.array(links[1])], names=["a", "b"])

    for batch in batches:
        key, part, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        now = [np.concatenate(x) for x in zip(held, (key, part, fp, home))] if not empty(held) else [key, part, fp, home]
        if not len(now[0]):
            continue
        changes = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        cut = int(changes[-1]) if len(changes) else 0
        if cut:
            yield out(_links(*(x[:cut] for x in now)))
        held = [x[cut:] for x in now]
        if len(held[0]) > HELD:
            yield out(_links(*held))
            held = [x[held[3]] for x in held]
    if not empty(held):
        yield out(_links(*held))


def near_links(prints: DataFrame, homes: int = HOMES) -> DataFrame:
    """(a, b): links among distinct fingerprints (one column fp) that join all near ones, without all their pairs."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys, rows, home = anchors_of(fp.view(np.uint64))
            yield pa.record_batch([pa.array(keys), pa.array(fp[rows]), pa.array(home)], names=["key", "fp", "home"])

    visits = prints.select("fp").mapInArrow(expand, "key long, fp long, home boolean")
    # At most 2 N / homes anchors are full. They are joined, not collected.
    full = materialise_table(visits.filter("home").groupBy("key").count().filter(F.col("count") > homes))
    n_full = full.count()
    if n_full:
        full = full.select("key", F.ceil(F.col("count") / homes).cast("int").alias("parts"))
        visits = visits.join(full, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        visits = visits.withColumn("home", F.col("home") & (F.col("part") == own))
    else:
        visits = visits.withColumn("part", F.lit(0))
    dealt = visits.select("key", "part", "fp", "home").repartition("key", "part").sortWithinPartitions("key", "part", F.desc("home"))
    return dealt.mapInArrow(_compare, "a long, b long")


def _grouped(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(_id, _digest, fp, _root: a fingerprint that names the component, component_id) of every row."""
    rows = materialise_table(fingerprints(docs, id_column, text_column, shingle))
    distinct = materialise_table(rows.groupBy("fp").agg(F.min("_id").alias("_first")))
    roots = components(near_links(distinct))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    joined = materialise_table(joined)
    named = joined.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return rows.join(joined.select("fp", "_root").join(named, "_root"), "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links) of every row."""
    print_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    found = _grouped(docs, id_column, text_column, shingle).select("_id", print_, "component_id")
    return found.toDF(id_column, "fingerprint", "component_id")


def near_families(nodes: DataFrame) -> DataFrame:
    """(a, b) to be compared, of nodes (node, m, fp): the first by size of each component of near fingerprints, with all others of it."""
    roots = components(near_links(materialise_table(nodes.select("fp").distinct())))
    named = nodes.join(roots.toDF("_fp", "_root"), F.col("fp") == F.col("_fp"), "left").withColumn("root", F.coalesce("_root", "fp"))
    named = materialise_table(named.select("root", "node", "m"))
    leads = named.groupBy("root").agg(F.min_by("node", F.struct("m", "node")).alias("a"), F.count("*").alias("n")).filter("n > 1").select("root", "a")
    return named.join(leads, "root").filter("node <> a").select("a", F.col("node").alias("b"))


def keep_one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """All columns of one row of each component of verified near copies: of the smallest id, a null id only where there is no other.

    Candidates are families of near fingerprints over ``shingle`` words, found through the anchors, and then what is similar without
    near fingerprints, found by ``near_copies``. Nothing is dropped unless the shingles themselves have the similarity.
    """
    keep = near_copies(docs, id_column, text_column, shingle, similarity, near_families)
    id_, digest = at(docs, id_column), F.xxhash64(at(docs, text_column).cast("string"))
    kept = sealed(docs).withColumn("_of", digest).join(keep, id_.eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_digest")))
    return kept.drop("_id", "_digest").dropDuplicates([f"c{docs.columns.index(id_column)}", "_of"]).drop("_of").toDF(*docs.columns)
