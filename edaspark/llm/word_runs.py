"""Maximal periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q and length of at least max(LEAST, 2 q) that no
neighbouring word extends under that period. The runs of all scales are found so: at scale B every
block of B words is compared with the windows that follow it at the distances of the scale. The
sum of squared differences of word numbers, for all distances at once, is two running sums less twice
a correlation, and the correlation is an exact integer number theoretic transform modulo PRIME. A distance without a
mismatch is a seed; it is extended to both sides word by word, which also settles equality where numbers
had to be folded to keep the sums under PRIME. Of runs over the same words the smallest period counts.

Scales are chosen so that every run holds a whole block with its copy: a run of period q repeats the words of an
interval of max(LEAST - q, q) words at least, and blocks of B at a stride s lie inside every interval of B + s - 1.
Two kinds of blocks are left out since they can seed nothing new: those with a word that has no equal at a distance of
the scale, and those that lie, with all their windows, in a run found before whose period is at most B.

Documents of a batch are searched together, with a number of its own between any two, which no run can hold.
A task holds the words of one batch (WORDS of them, or one longer document) and, at the largest scale, some 16 numbers per word.

A null, empty or blank text has no words, no runs, and an empty collapsed text. Repeated rows and null ids are treated each as it
stands. An empty table gives no rows. Columns named as the results are replaced; all others are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, sealed

LEAST = 12
# A prime 15 * 2^27 + 1 with the primitive root 31: transforms of up to 2^27 numbers, products below 2^62.
PRIME, ROOT = 2013265921, 31
WORDS = 1 << 18
# Numbers that are transformed together.
CELLS = 1 << 19

P = np.uint64(PRIME)


@lru_cache(maxsize=64)
def _powers(h: int, inverse: bool) -> np.ndarray:
    """The first h powers of a primitive root of unity of order 2 h."""
    w = pow(ROOT, (PRIME - 1) // (2 * h), PRIME)
    w = pow(w, PRIME - 2, PRIME) if inverse else w
    out = np.ones(h, np.uint64)
    k = 1
    while k < h:
        out[k : 2 * k] = out[:k] * np.uint64(pow(w, k, PRIME)) % P
        k *= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Each row's transform, in bit-reversed order."""
    x, h = rows, rows.shape[1] // 2
    while h:
        x = x.reshape(len(rows), -1, 2, h)
        a, b = x[:, :, 0], x[:, :, 1]
        out = np.empty_like(x)
        total = a + b
        np.subtract(total, P, out=total, where=total >= P)
        out[:, :, 0] = total
        out[:, :, 1] = (a + (P - b)) * _powers(h, False) % P
        x, h = out, h // 2
    return x.reshape(rows.shape)


def untransform(rows: np.ndarray) -> np.ndarray:
    """The rows whose transforms, in bit-reversed order, are given."""
    x, h, size = rows, 1, rows.shape[1]
    while h < size:
        x = x.reshape(len(rows), -1, 2, h)
        a, b = x[:, :, 0], x[:, :, 1] * _powers(h, True) % P
        out = np.empty_like(x)
        for side, y in ((0, a + b), (1, a + (P - b))):
            np.subtract(y, P, out=y, where=y >= P)
            out[:, :, side] = y
        x, h = out, 2 * h
    return x.reshape(rows.shape) * np.uint64(pow(size, PRIME - 2, PRIME)) % P


def mismatches(values: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> np.ndarray:
    """Sums of squared differences between the block at each start and the one so many places on, for low to high places.

    Exact as long as block times the largest value squared is under PRIME. Values end in zeros enough for every window.
    """
    shifts = high - low + 1
    size = 1 << (shifts + block - 2).bit_length()
    x = np.zeros((len(starts), size), np.uint64)
    own = values[starts[:, None] + np.arange(block)]
    x[:, -np.arange(block) % size] = own
    window = values[starts[:, None] + low + np.arange(shifts + block - 1)]
    y = np.zeros((len(starts), size), np.uint64)
    y[:, : window.shape[1]] = window
    product = untransform(transform(x) * transform(y) % P)[:, :shifts].astype(np.int64)
    own, window = own.astype(np.int64), window.astype(np.int64)
    sums = np.zeros((len(starts), window.shape[1] + 1), np.int64)
    np.cumsum(window * window, axis=1, out=sums[:, 1:])
    return (own * own).sum(1)[:, None] + sums[:, block : block + shifts] - sums[:, :shifts] - 2 * product


def scales(longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(block, stride, lowest, highest distance), for texts of so many words."""
    yield 4, 2, 1, 14
    block = 8
    while 2 * (2 * block - 1) <= longest:
        yield block, block, 2 * block - 1, 4 * block - 2
        block *= 2


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading numbers are equal, looking ever further ahead."""
    done, step, n = 0, 32, min(len(a), len(b))
    while done < n:
        off = np.flatnonzero(a[done : done + step] != b[done : done + step])[:1]
        if len(off):
            return min(done + int(off[0]), n)
        done, step = done + step, 2 * step
    return n


def _extended(ids: np.ndarray, seeds: np.ndarray, q: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, q) of the stretches of period q around the seeds, which ascend."""
    k = 0
    while k < len(seeds):
        at_ = int(seeds[k])
        right = _agree(ids[at_ : len(ids) - q], ids[at_ + q :])
        if right < block:
            k += 1
            continue
        left = _agree(ids[:at_][::-1], ids[q : at_ + q][::-1])
        length = left + right + q
        if length >= max(LEAST, 2 * q):
            yield at_ - left, length, q
        k = int(np.searchsorted(seeds, at_ + right - block + 1))


def find_runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start, then period.

    ids are word numbers; the texts' ends are the places of numbers that occur once.
    """
    n = len(ids)
    found = np.empty((0, 3), np.int64)
    if n < LEAST:
        return found
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    nearest, farthest = np.full(n, 2 * n), np.zeros(n, np.int64)
    nearest[order[:-1][same]] = (order[1:] - order[:-1])[same]
    last = np.empty(int(ids.max()) + 1, np.int64)
    closing = np.append(~same, True)
    last[ids[order[closing]]] = order[closing]
    farthest = last[ids] - np.arange(n)
    longest = int(np.diff(ends, prepend=-1).max())
    for block, stride, low, high in scales(longest):
        able = (nearest <= high) & (farthest >= low)
        if not able.any():
            continue
        unable = np.zeros(n + 1, np.int64)
        np.cumsum(~able, out=unable[1:])
        starts = np.arange(0, n - block - low + 1, stride)
        starts = starts[unable[starts + block] == unable[starts]]
        short = found[found[:, 2] <= block]
        if len(short) and len(starts):
            reach = np.maximum.accumulate(short[:, 0] + short[:, 1])
            held = np.searchsorted(short[:, 0], starts, "right") - 1
            limit = np.minimum(starts + block + high, ends[np.searchsorted(ends, starts)])
            starts = starts[(held < 0) | (reach[held] < limit)]
        if not len(starts):
            continue
        fold = int(((PRIME - 1) // block) ** 0.5)
        values = np.zeros(n + high + block, np.uint64)
        values[:n] = ids % fold
        rows = max(1, CELLS // (4 * (high + block)))
        seeds: dict[int, list[np.ndarray]] = {}
        for k in range(0, len(starts), rows):
            part = starts[k : k + rows]
            places, shifts = np.nonzero(mismatches(values, part, block, low, high) == 0)
            for q in np.unique(shifts):
                seeds.setdefault(int(q) + low, []).append(part[places[shifts == q]])
        more = [run for q, at_ in seeds.items() for run in _extended(ids, np.concatenate(at_), q, block)]
        if more:
            found = np.concatenate((found, np.array(more, np.int64)))
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            smallest = np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(1))
            found = found[smallest]
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found


def runs_of_texts(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    split = [(text or b"").split() for text in texts]
    sizes = np.array([len(words) for words in split], np.int64)
    numbers: dict[bytes, int] = defaultdict(count(len(split)).__next__)
    ids = np.empty(int(sizes.sum()) + len(split), np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    for k, (a, words) in enumerate(zip(begins.tolist(), split)):
        ids[a : a + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        ids[a + len(words)] = k
    runs = find_runs(ids, begins + sizes)
    bounds = np.searchsorted(runs[:, 0], [*begins, len(ids)])
    for k, words in enumerate(split):
        own = runs[bounds[k] : bounds[k + 1]]
        if not len(own):
            yield len(words), own, b" ".join(words)
            continue
        own = own - [begins[k], 0, 0]
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, own[:, 0] + own[:, 2], 1)
        np.add.at(depth, own[:, 0] + own[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        yield len(words), own, b" ".join(map(words.__getitem__, kept.tolist()))


RESULTS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _batches(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Spans of texts with about WORDS words together, by their bytes."""
    a = held = 0
    for k, text in enumerate(texts):
        size = len(text or b"") // 4
        if held and held + size > WORDS:
            yield a, k
            a, held = k, 0
        held += size
    if a < len(texts):
        yield a, len(texts)


def periodic_runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns with n_words, runs (by start, then period) and collapsed.

    The collapsed text holds, joined by one space, the words that no run contains after its first period.
    """
    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    plain = sealed(docs).select(*[at(docs, c) for c in names], at(docs, text_column).cast("string").cast("binary").alias("_text"))
    kept = ", ".join(f"c{k} {plain.schema[k].dataType.simpleString()}" for k in range(len(names)))
    plain = plain.toDF(*[f"c{k}" for k in range(len(names))], "_text")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for a, b in _batches(texts):
                sizes, runs, short = zip(*runs_of_texts(texts[a:b]))
                offsets = np.cumsum([0, *map(len, runs)])
                columns = np.concatenate(runs).T
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], fields=list(run))
                )
                own = [c.slice(a, b - a) for c in batch.columns[:-1]]
                results = [pa.array(sizes, pa.int64()), lists, pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *results], [*[f"c{k}" for k in range(len(names))], "n_words", "runs", "collapsed"])

    return plain.mapInArrow(rows, f"{kept}, {RESULTS}").toDF(*names, "n_words", "runs", "collapsed")


def longest_run() -> Column:
    """Of a row of ``periodic_runs``, the longest run (ties: smallest start, then period) as (length, start, period), or null."""
    first = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    return F.when(first.isNotNull(), F.struct(first["length"].alias("length"), (-first["start"]).alias("start"), (-first["period"]).alias("period")))


def replayed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document in ten with a stretch of its words said over and over to the end, as cases for the search; other texts stay as they are.

    The stretch starts at word a = g % n and has 1 + (n - a) / (3 + g % 8) words, for the n words of the text and the tenth g of the id's crc32.
    """
    h = F.crc32(at(docs, id_column).cast("string").cast("binary"))
    text = at(docs, text_column).cast("string")
    chosen = sealed(docs).withColumns({"_g": F.floor(h / 10), "_w": F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")))})
    n = F.size("_w")
    chosen = chosen.withColumn("_a", F.when(n > 0, F.pmod("_g", n)).cast("int"))
    chosen = chosen.withColumn("_p", (F.expr("1 + (size(_w) - _a) div (3 + _g % 8)")).cast("int"))
    times = F.expr("cast((size(_w) - _a) div _p + 1 as int)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), n - F.col("_a"))
    said = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")
    said = F.when(F.col("_a").isNotNull(), said).otherwise(text)
    return chosen.select(*[said if c == text_column else at(docs, c) for c in docs.columns]).toDF(*docs.columns)
