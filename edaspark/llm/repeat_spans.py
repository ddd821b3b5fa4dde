"""Repeated byte strings across all documents, by ranks of growing prefixes over sampled positions.

Removed is each byte that a string of LENGTH (100) bytes covers which also starts earlier: in a document of
smaller id, or earlier in the same one. A suffix array by plain prefix doubling would sort one pair of
ranks per byte and round. Here positions are sampled by content, and a round goes on only where ranks are not yet unique:

* Every window of 100 bytes has an anchor, its leftmost 32-byte string of smallest hash. Equal windows have equal
  anchors, so only windows whose anchors are equal need comparing. Windows that share an anchor place are a segment.
* Round 0 sorts (rank of the 32 bytes at the anchor, rank of the whole segment, position). Segments equal to an earlier one are
  repeats as a whole. An anchor string met in one segment only is unique. The first of each other segment goes on.
* Round 1 does the same for pieces of up to 5 windows, which have 96 bytes in common, round 2 for windows of 100 bytes.

Ranks are 64-bit hashes; segments count as equal when the ranks of their common bytes and of the whole agree, so 128 bits. Tasks
first drop repeats within an Arrow batch, so what a group of copies sends on grows with batches and not with copies. Groups are
streamed in sorted order and never held.

A null text has no bytes. Documents are told apart by id and text; ids are integers, a null id is the smallest, and rows of one id are ordered by a
hash of their text. Of equal rows the first is judged as one and the others are repeats of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import materialise_table
from .common import at, sealed

LENGTH = 100
ANCHOR = 32
SPREAD = LENGTH - ANCHOR + 1  # anchor places in a window
STEP = 5  # windows of a piece in round 1
# Bytes hashed at a time, and bits of a place among them.
CHUNK, PLACE_BITS = 1 << 20, 21
# Places of a table that narrows down which documents are read again; bounds that table's rows.
PLACES = 1 << 19
FIRST, SECOND = 6364136223846793005, 2862933555777941757  # odd multipliers
MASK = (1 << 64) - 1

ROWS = "k long, full long, id long, tie long, start int, end int, off int"
JUDGED = "id long, tie long, start int, end int, off int, repeat boolean"

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64; kept per process."""
    held = _POWERS.get(multiplier)
    if held is None or len(held[0]) < n:
        size = max(n, 2 * CHUNK + 2 * LENGTH)
        both = []
        for m in (multiplier, pow(multiplier, -1, 1 << 64)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        held = _POWERS[multiplier] = tuple(both)
    return held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring of the data, from running sums."""

    def __init__(self, data: np.ndarray, multiplier: int):
        self.up, self.down = powers(multiplier, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        return mixed((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: bytes, and for each part of a text its number, where it begins in the text, and its size.

    A long text comes in parts that overlap by a window less a byte, so every window is in one part.
    """
    parts, number, begin, size = [], [], [], 0
    for k, text in enumerate(texts):
        for s in range(0, len(text or b"") - LENGTH + 1, CHUNK):
            part = text[s : s + CHUNK + LENGTH - 1]
            if parts and size + len(part) > CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(number), np.array(begin), np.array([len(p) for p in parts])
                parts, number, begin, size = [], [], [], 0
            parts.append(part), number.append(k), begin.append(s)
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(number), np.array(begin), np.array([len(p) for p in parts])


def segments(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Segments of all texts: anchor rank, segment rank, text number, start, end, anchor less start."""
    out = [[np.empty(0, np.int64)] * 6]
    for data, number, begin, size in _chunks(texts):
        a, b = Hashes(data, FIRST), Hashes(data, SECOND)
        ranks = a.all(ANCHOR)
        low = (ranks >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(ranks), dtype=np.uint64)
        width = 1
        while 2 * width <= SPREAD:  # smallest of the next `width` places, the leftmost on ties
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPREAD:
            low = np.minimum(low[: len(low) - (SPREAD - width)], low[SPREAD - width :])
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size - LENGTH + 1)
        window = np.arange(len(part)) + np.repeat((LENGTH - 1) * np.arange(len(size)), size - LENGTH + 1)
        anchor = (low[window] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
        last = np.concatenate((change[1:], [len(part)])) - 1
        lo, end, q, part = window[change], window[last] + LENGTH, anchor[change], part[change]
        full = b.of(lo, end) + mixed(((q - lo) * 1024 + (end - lo)).astype(np.uint64))
        start = lo - first[part] + begin[part]
        out.append([ranks[q].view(np.int64), full.view(np.int64), number[part], start, start + end - lo, q - lo])
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans of each owner."""
    if not len(owner):
        return owner, start, end
    sort = np.lexsort((start, owner))
    owner, start, end = owner[sort], start[sort], end[sort]
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + owner * far)  # an owner's spans stay below the next one's
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] + owner[1:] * far > reach[:-1])))
    at_ = np.flatnonzero(new)
    stop = np.concatenate((at_[1:], [len(owner)])) - 1
    return owner[at_], start[at_], reach[stop] - owner[at_] * far


def _combined(ids: np.ndarray, ties: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Rows of a batch's segments: of equal ones the earliest; what the others cover goes as repeats (off -1)."""
    key, full, number, start, end, off = found
    order = np.lexsort((ties, ids))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    distinct = np.concatenate(([0], np.cumsum((np.diff(ids[order]) != 0) | (np.diff(ties[order]) != 0)))) if len(ids) else rank
    rank = distinct[rank]  # equal rows are one document
    place = (rank[number] << 32) | start
    sort = np.lexsort((place, key ^ full))
    k, f, p = key[sort], full[sort], place[sort]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])))[: len(k)]
    firsts = np.flatnonzero(new)
    # What follows an equal segment repeats it, unless it is the same place (of equal rows).
    elsewhere = p != p[firsts][np.cumsum(new) - 1]
    keep, drop = sort[new], sort[elsewhere]
    owner, s, e = merged(number[drop], start[drop], end[drop])
    number = np.concatenate((number[keep], owner))
    none = np.zeros(len(owner), np.int64)
    own = mixed(ids[owner].view(np.uint64) ^ ties[owner].astype(np.int64).view(np.uint64)).view(np.int64)
    columns = [
        np.concatenate((key[keep], own)), np.concatenate((full[keep], none)), ids[number], ties[number],
        np.concatenate((start[keep], s)).astype(np.int32), np.concatenate((end[keep], e)).astype(np.int32),
        np.concatenate((off[keep], none - 1)).astype(np.int32),
    ]
    return pa.record_batch([pa.array(c) for c in columns], names=["k", "full", "id", "tie", "start", "end", "off"])


def _round_0(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        yield _combined(ids, ties, segments(batch.column(2).to_pylist()))


def _spread(texts: list[bytes], lists: list, pieces: bool) -> tuple[np.ndarray, ...]:
    """Pieces of STEP windows, or windows, of the given segments of each text."""
    out = [[np.empty(0, np.int64)] * 6]
    run: list[int] = []

    def work() -> None:
        data = np.frombuffer(b"".join(texts[k] for k in run), np.uint8)
        first = np.cumsum([0, *[len(texts[k]) for k in run]])
        flat = [(j, s["start"], s["end"], s["off"]) for j, k in enumerate(run) for s in lists[k]]
        part, start, end, off = np.array(flat, np.int64).reshape(-1, 4).T
        a, b = Hashes(data, FIRST), Hashes(data, SECOND)
        near, far = start + off - (end - LENGTH), off  # anchor less last and first window
        if pieces:
            lowest, n = near // STEP, far // STEP - near // STEP + 1
            of = np.repeat(np.arange(len(part)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lowest[of]
            q = start[of] + off[of]
            s, e = q - np.minimum(far[of], j * STEP + STEP - 1), q - np.maximum(near[of], j * STEP) + LENGTH
            base = first[part[of]]
            common = base + q - j * STEP
            key = a.of(common, common + LENGTH - STEP + 1) + mixed(j.astype(np.uint64))
            full = b.of(base + s, base + e) + mixed(((q - s) * 1024 + (e - s)).astype(np.uint64))
            o = q - s
        else:
            n = end - start - LENGTH + 1
            of = np.repeat(np.arange(len(part)), n)
            s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[of]
            e, o = s + LENGTH, np.zeros(len(of), np.int64)
            base = first[part[of]]
            key, full = a.of(base + s, base + e), b.of(base + s, base + e)
        out.append([key.view(np.int64), full.view(np.int64), np.array(run)[part[of]], s, e, o])

    size = 0
    for k, text in enumerate(texts):
        if run and size + len(text) > CHUNK:
            work()
            run, size = [], 0
        run.append(k)
        size += len(text)
    if run:
        work()
    return tuple(np.concatenate(x) for x in zip(*out))


def _later(pieces: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at_ in range(0, whole.num_rows, 2048):
                batch = whole.slice(at_, 2048)
                ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield _combined(ids, ties, _spread(batch.column(2).to_pylist(), batch.column(3).to_pylist(), pieces))

    return rows


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, full, id, tie, start): repeats of an equal earlier segment, and firsts whose k has several segments."""
    key = full = place = None  # of the last segment: its ranks, and where it is met first
    waiting = None  # the first row of its k, while it is the only segment of that k
    for batch in batches:
        k, f, id_, tie, start, end, off = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        known = off < 0
        rest = np.flatnonzero(~known)
        repeat = known.copy()
        open_ = np.zeros(len(k), bool)
        extra = None
        if len(rest):
            kk, ff = k[rest], f[rest]
            new_k = np.concatenate(([kk[0] != key or key is None], kk[1:] != kk[:-1]))
            new_f = new_k | np.concatenate(([ff[0] != full or full is None], ff[1:] != ff[:-1]))
            where = np.column_stack((id_[rest], tie[rest], start[rest]))
            of = np.maximum.accumulate(np.where(new_f, np.arange(len(rest)), -1))
            first = where[np.maximum(of, 0)]
            if of[0] < 0:
                first[of < 0] = place
            repeat[rest] = ~new_f & (where != first).any(1)  # the same place, met in equal rows, is no repeat
            later = new_f & ~new_k  # not the first segment of its k
            open_[rest[later]] = True
            group = np.cumsum(new_k)  # 0: the group that the last batch ended in
            several = np.bincount(group, later, minlength=int(group[-1]) + 1) > 0
            open_[rest[new_k]] = several[group[new_k]]
            if waiting is not None and several[0]:
                extra = waiting
            if new_k.any() or several[0]:
                waiting = None
            if new_k.any() and not several[-1]:
                i = rest[np.flatnonzero(new_k)[-1]]
                waiting = [x[i : i + 1].copy() for x in (id_, tie, start, end, off)]
            key, full, place = kk[-1], ff[-1], first[-1]
        take = np.flatnonzero(repeat | open_)
        columns = [x[take] for x in (id_, tie, start, end, off)]
        flags = repeat[take]
        if extra is not None:
            columns = [np.concatenate((x, y)) for x, y in zip(columns, extra)]
            flags = np.concatenate((flags, [False]))
        yield pa.record_batch([*map(pa.array, columns), pa.array(flags)], names=["id", "tie", "start", "end", "off", "repeat"])


def _reranked(rows: DataFrame) -> DataFrame:
    """One round: sort by ranks and position, and tell repeats from segments to go on with; written to the shared folder."""
    dealt = rows.repartition("k").sortWithinPartitions("k", "full", "id", "tie", "start")
    return materialise_table(dealt.mapInArrow(_judge, JUDGED))


def _open(round_: DataFrame) -> DataFrame:
    segs = F.collect_list(F.struct("start", "end", "off")).alias("segs")
    return round_.filter("not `repeat`").groupBy("id", "tie").agg(segs)


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, tie, text as bytes, given id)."""
    given, text = at(docs, id_column), F.coalesce(at(docs, text_column).cast("binary"), F.lit(b""))
    low: Column = F.coalesce(given.cast("long"), F.lit(-(1 << 63)))
    tie = F.xxhash64(text)
    return sealed(docs).select(low.alias("id"), tie.alias("tie"), text.alias("text"), given.alias("given"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tie, spans: start and end of repeated runs, unmerged) of the documents that have some."""
    texts = _documents(docs, id_column, text_column).select("id", "tie", "text")
    first = _reranked(texts.mapInArrow(_round_0, ROWS))
    place = F.pmod(F.xxhash64("id", "tie"), F.lit(PLACES))
    todo = _open(first)
    places = first.filter("not `repeat`").select(place.alias("place")).distinct()  # at most PLACES rows
    again = texts.withColumn("place", place).join(F.broadcast(places), "place", "left_semi").drop("place")
    again = materialise_table(again.join(todo, ["id", "tie"]).select("id", "tie", "text", "segs"))
    second = _reranked(again.mapInArrow(_later(True), ROWS))
    again = again.select("id", "tie", "text").join(_open(second), ["id", "tie"])
    third = _reranked(again.mapInArrow(_later(False), ROWS))
    found = first.unionAll(second).unionAll(third).filter("`repeat`")
    return found.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, kept: the remaining bytes, spans: (start, end) of the removed runs) of every row."""
    spans = repeated_spans(docs, id_column, text_column)
    texts = _documents(docs, id_column, text_column).join(spans, ["id", "tie"], "left")
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("id", "tie", F.sha2("text", 256)).orderBy("tie")))
    plain = texts.select("given", "text", "copy", "spans")
    schema = plain.selectExpr("given", "0L as n_bytes", "text as kept", "cast(null as array<struct<start:int,end:int>>) as spans").schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, out = [], [], []
            for text, copy, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                n = len(text)
                if copy > 1:
                    runs = [(0, n)] if n >= LENGTH else []
                else:
                    s, e = (np.array([x[name] for x in found or ()], np.int64) for name in ("start", "end"))
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                    runs = list(zip(s.tolist(), e.tolist()))
                ends = [0, *[e for _, e in runs]]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*[s for s, _ in runs], n])))
                sizes.append(n)
                out.append([{"start": s, "end": e} for s, e in runs])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(out, kind)], names=schema.names)

    return plain.mapInArrow(rows, schema).toDF(id_column, "n_bytes", "kept", "spans")
