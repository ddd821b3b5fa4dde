"""Seeded merge-dropout segmentation with a merge-type SentencePiece vocabulary, and its exact decoding.

Symbols of a chunk merge in agenda order (best-ranked pair first, leftmost on ties), and each
candidate merge taken from the agenda is skipped when its keyed hash falls below the dropout rate.
Without dropout this is the vocabulary's own segmentation. Characters outside the vocabulary, and
a literal U+2581, become byte pieces, so decoding gives back every text.

The key of a chunk is a keyed hash of the seed, the document's id and the chunk's place, so every occurrence of
a word draws its own merges, and a run can be repeated exactly. What becomes of a chunk depends only on which of
the merges that come up are skipped: tasks remember, for short chunks, the merges that come up when certain steps of the
agenda are skipped and no later one, with the ids that this gives. Every occurrence draws the merges of its chunk in one step; the
first one skipped leads to the next such course, until none is. These courses are kept in a table of bounded size.

A null text has null ids, an empty one none. A null id is keyed as the text "null". Repeated rows are alike.
The vocabulary file is read once by the driver and sent to the executors: its size is that of a tokenizer.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, kept, sealed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# No piece has a space after another character, so chunks of spaces and what follows are apart from each other.
CHUNK = re.compile(" *[^ \n▁]+| +|\n|▁")
# Chunks that a task remembers (courses: twice as many before it starts anew, four times at most), and the longest chunk that is remembered.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 32
# Steps of an agenda whose skips are remembered; a chunk that skips a later one is segmented by itself.
STEPS = 62
# Rows encoded or decoded at a time.
ROWS = 256
# Chunks segmented together, and texts whose chunks are.
TOGETHER, TEXTS = 2048, 256
# A candidate merge as one number, the lowest first: order of the merge, place in the chunk, id of what it makes.
PLACE_AT, ORDER_AT = 24, 32
NO_MERGE = np.int64((1 << 62) - 1)


def keys_of(seed: int, id_: object, n: int) -> np.ndarray:
    """30-bit keys of a document's first n chunks."""
    base = hashlib.blake2b(str(id_).encode(), key=seed.to_bytes(8, "little", signed=True), digest_size=8).digest()
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.frombuffer(base, "<u8")
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(34)).astype(np.int64)


def skipped(keys: np.ndarray, codes: np.ndarray, threshold: int) -> np.ndarray:
    """Whether chunks of these keys skip the merges of these codes."""
    return (((keys ^ codes) & 0x3FFFFFFF) * 0x2C1B3C6D >> 11 & 0x3FFFFFFF) < threshold


class Merges:
    """Pairs of ids to numbers, one place to look at for each: rows of the sparse matrix of pairs lie shifted over each other in one array."""

    def __init__(self, lefts: np.ndarray, rights: np.ndarray, numbers: np.ndarray, n_ids: int):
        order = np.lexsort((rights, lefts))
        lefts, rights, numbers = lefts[order], rights[order], numbers[order]
        firsts = np.flatnonzero(np.diff(lefts, prepend=-1))
        sizes = np.diff(firsts, append=len(lefts))
        room, tries = 4 * len(lefts) + n_ids, np.random.default_rng(0)
        free = np.ones(room + n_ids, bool)
        # Ids without pairs on their right look at places of others.
        self.shift = np.zeros(n_ids, np.int64)
        for row in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)].tolist():  # the longest row first, while there is room
            own, tried = rights[firsts[row] : firsts[row] + sizes[row]], 0
            while not len(fits := np.flatnonzero(free[(shifts := tries.integers(0, room, 64))[:, None] + own].all(1))):
                tried += 1
                if tried % 8 == 0:
                    free, room = np.append(free, np.ones(room, bool)), 2 * room
            self.shift[lefts[firsts[row]]] = shifts[fits[0]]
            free[shifts[fits[0]] + own] = False
        alone = firsts[sizes == 1]
        self.shift[lefts[alone]] = np.flatnonzero(free[n_ids:])[: len(alone)] + n_ids - rights[alone]
        places = self.shift[lefts] + rights
        self.left, self.number = np.full(len(free), -1, np.int32), np.full(len(free), NO_MERGE)
        self.left[places], self.number[places] = lefts, numbers

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' numbers, NO_MERGE for others."""
        at_ = self.shift.take(left)
        at_ += right
        return np.where(self.left.take(at_) == left, self.number.take(at_), NO_MERGE)


class Remembered:
    """Courses of chunks' agendas: which steps are skipped, the codes of the merges that come up after the last of these, and the ids if none of those is."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.next: dict[int, int] = {}
        self.chunks: list[str] = []
        self.ids, self.skips = np.empty(1 << 12, object), np.zeros(1 << 12, np.int64)
        self.steps, self.ends = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.codes = np.empty(1 << 16, np.int64)

    def add(self, chunks: list[str], skips: np.ndarray, steps: np.ndarray, ids: list[bytes], codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new courses; ``steps`` come before the codes."""
        first, end = len(self.chunks), len(self.chunks) + len(chunks)
        start = int(self.ends[first])
        while start + len(codes) > len(self.codes):
            self.codes = np.concatenate((self.codes, np.empty_like(self.codes)))
        while end >= len(self.ends):
            self.ids, self.skips, self.steps, self.ends = (np.concatenate((x, np.empty_like(x))) for x in (self.ids, self.skips, self.steps, self.ends))
        self.codes[start : start + len(codes)] = codes
        self.ids[first:end], self.skips[first:end], self.steps[first:end] = ids, skips, steps
        self.ends[first + 1 : end + 1] = start + np.cumsum(sizes)
        self.chunks += chunks
        return np.arange(first, end)

    def first_skipped(self, courses: np.ndarray, keys: np.ndarray, threshold: int) -> np.ndarray:
        """For chunks of these keys on these courses, the number of the first of its codes that is skipped, or -1."""
        starts = self.ends[courses]
        sizes = self.ends[courses + 1] - starts
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(courses)), sizes)
        shift = starts - (ends - sizes)
        out = np.flatnonzero(skipped(keys[of], self.codes[np.arange(len(of)) + shift[of]], threshold))
        of = of[out]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        found = np.full(len(courses), -1)
        found[of[first]] = out[first] - (ends - sizes)[of[first]]
        return found


class Pieces:
    """Ranks and ids of a merge-type vocabulary."""

    def __init__(self, model: bytes):
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(known.vocab_size()):
            piece = known.id_to_piece(i)
            if known.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif known.is_control(i) or known.is_unknown(i) or known.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece has a space after another character")
                self.rank[piece] = (-known.get_score(i), i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.parts = pa.array(self.bytes_of, pa.binary())
        self.salt = [crc32(b"%d" % i) >> 2 for i in range(known.vocab_size())]
        self.remembered = Remembered()
        # The same as arrays: pieces of one character by code point, and merges of two pieces by both ids.
        self.none = known.vocab_size()
        self.characters = np.full(0x110000, self.none, np.int64)
        lefts, rights, scores, ids = [], [], [], []
        for piece, (score, i) in self.rank.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = i
            for cut in range(1, len(piece)):
                left, right = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if left and right:
                    lefts.append(left[1])
                    rights.append(right[1])
                    scores.append(score)
                    ids.append(i)
        order = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        self.merges = Merges(np.array(lefts), np.array(rights), order << ORDER_AT | np.array(ids), self.none + 1)
        self.salts = np.array(self.salt)

    def segment(self, chunk: str, key: int, threshold: int) -> list[int]:
        """Ids of a chunk; spaces in it stand for SPACE, and a chunk that is SPACE itself becomes bytes.

        ``key`` and ``threshold`` are of 30 bits; a merge is skipped when its hash is below the threshold.
        """
        if chunk == SPACE:
            return [self.byte_ids[b] for b in chunk.encode()]
        rank, salt = self.rank, self.salt
        parts = list(chunk.replace(" ", SPACE))
        n = len(parts)
        agenda = []
        for i in range(n - 1):
            text = parts[i] + parts[i + 1]
            if text in rank:
                score, piece = rank[text]
                agenda.append((score, i, i + 1, piece, text))
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, i, j, piece, text = pop(agenda)
            left = parts[i]
            if not left or after[i] != j or not parts[j] or len(left) + len(parts[j]) != len(text):
                continue
            if threshold and ((key ^ salt[piece] ^ i * 0x27D4EB2F) & 0x3FFFFFFF) * 0x2C1B3C6D >> 11 & 0x3FFFFFFF < threshold:
                continue
            parts[i], parts[j] = text, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = text + parts[k]
                if longer in rank:
                    score, piece = rank[longer]
                    push(agenda, (score, i, k, piece, longer))
            h = before[i]
            if h >= 0:
                longer = parts[h] + text
                if longer in rank:
                    score, piece = rank[longer]
                    push(agenda, (score, h, i, piece, longer))
        out = []
        for part in parts:
            if part:
                if part in rank:
                    out.append(rank[part][1])
                else:
                    out += [self.byte_ids[b] for b in part.encode()]
        return out

    def segment_many(self, chunks: list[str], keys: np.ndarray, threshold: int) -> list[bytes]:
        """``segment`` of many short chunks, ids as bytes."""
        return self._agendas(chunks, lambda rows, codes, step: skipped(keys[rows], codes, threshold))

    def _agendas(self, chunks: list[str], skips: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> list[bytes]:
        """Ids of many short chunks as bytes, each step of their agendas taken together; ``skips`` tells for chunks and codes whether the merge is skipped."""
        n, width = len(chunks), max(map(len, chunks))
        points = np.array(chunks, f"<U{width}").view(np.uint32).reshape(n, width).T
        points = np.where(points == ord(" "), ord(SPACE), points)
        held = np.arange(width)[:, None] < np.fromiter(map(len, chunks), np.int64, n)
        # A row for each place, and one before and after them; below, a number stands for a place of a chunk, row by row.
        ids = np.full((width + 2, n), self.none)
        ids[1:-1] = np.where(held, self.characters[points], self.none)
        best = np.full((width + 2, n), NO_MERGE)
        found = self.merges.find(ids[1:-2], ids[2:-1])
        best[1:-2] = np.where(found < NO_MERGE, found | (np.arange(1, width) << PLACE_AT)[:, None], NO_MERGE)
        after = np.arange(n, (width + 3) * n)
        before = after - 2 * n
        flat_ids, flat_best, flat_held = ids.reshape(-1), best.reshape(-1), held.reshape(-1)
        for step in count():
            own = best.min(0)
            rows = np.flatnonzero(own < NO_MERGE)
            if not len(rows):
                break
            own = own[rows]
            now, i = own & ((1 << PLACE_AT) - 1), (own >> PLACE_AT) & ((1 << ORDER_AT - PLACE_AT) - 1)
            here = i * n + rows
            skip = skips(rows, (self.salts.take(now) ^ (i - 1) * 0x27D4EB2F) & 0x3FFFFFFF, step)
            flat_best[here[skip]] = NO_MERGE
            here, now = here[~skip], now[~skip]
            j = after.take(here)
            k, h = after.take(j), before.take(here)
            flat_ids[here] = now
            flat_held[j - n] = False
            flat_best[j] = NO_MERGE
            after[here], before[k] = k, here
            places = np.concatenate((here, h))
            found = self.merges.find(np.concatenate((now, flat_ids.take(h))), np.concatenate((flat_ids.take(k), now)))
            flat_best[places] = np.where(found < NO_MERGE, found | places // n << PLACE_AT, NO_MERGE)
        ids, held = ids[1:-1].T, held.T
        flat = ids[held].astype("<i4").tobytes()
        ends = (4 * np.cumsum(held.sum(1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for row in np.flatnonzero((held & (ids == self.none)).any(1)).tolist():  # bytes for unknown characters
            letters, own = chunks[row].replace(" ", SPACE), []
            for i in np.flatnonzero(held[row]).tolist():
                own += [ids[row, i]] if ids[row, i] != self.none else [self.byte_ids[b] for b in letters[i].encode()]
            out[row] = np.array(own, "<i4").tobytes()
        return out

    def _segmented(self, chunks: list[str], keys: np.ndarray, threshold: int) -> list[bytes]:
        """Ids of chunks as bytes, those of short chunks that come more than once by courses remembered."""
        if max(len(self.remembered.places), len(self.remembered.chunks) // 2) >= REMEMBERED:
            self.remembered = Remembered()
        memory = self.remembered
        courses = np.fromiter(map(memory.places.get, chunks, repeat(-1)), np.int64, len(chunks))
        # A chunk is remembered when it comes twice among these; others new here are segmented as they are.
        new = np.flatnonzero(courses < 0)
        names = [chunks[k] for k in new.tolist()]
        twice = [c for c, n in Counter(names).items() if n > 1 and len(c) <= REMEMBERED_LENGTH and c != SPACE][:REMEMBERED]
        memory.places.update(zip(twice, self._courses(twice, np.zeros(len(twice), np.int64), np.zeros(len(twice), np.int64)).tolist()))
        courses[new] = np.fromiter(map(memory.places.get, names, repeat(-1)), np.int64, len(names))
        left = np.flatnonzero(courses >= 0)
        while threshold and len(left):
            step = memory.first_skipped(courses[left], keys[left], threshold)
            left, step = left[step >= 0], step[step >= 0]
            step += memory.steps[courses[left]]
            courses[left[step >= STEPS]] = -1
            left, step = left[step < STEPS], step[step < STEPS]
            wanted, first, of = np.unique(courses[left] << 6 | step, return_index=True, return_inverse=True)
            found = np.fromiter(map(memory.next.get, wanted.tolist(), repeat(-1)), np.int64, len(wanted))
            absent = np.flatnonzero(found < 0)[: max(0, 4 * REMEMBERED - len(memory.chunks))]
            before, step = courses[left[first[absent]]], step[first[absent]]
            found[absent] = self._courses([memory.chunks[k] for k in before.tolist()], memory.skips[before] | np.int64(1) << step, step + 1)
            memory.next.update(zip(wanted[absent].tolist(), found[absent].tolist()))
            courses[left] = found[of]
            left = left[courses[left] >= 0]
        rest = np.flatnonzero(courses < 0)
        out = memory.ids[courses]
        # Short ones many at a time, of about one length.
        names = [chunks[k] for k in rest.tolist()]
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(lengths, kind="stable")
        rest, names = rest[order], [names[k] for k in order.tolist()]
        n_short = int(np.searchsorted(lengths[order], REMEMBERED_LENGTH, "right"))
        for start in range(0, n_short, TOGETHER):
            own = rest[start : min(start + TOGETHER, n_short)]
            out[own] = self.segment_many(names[start : start + len(own)], keys[own], threshold)
        for k, name in zip(rest.tolist(), names):
            if len(name) > REMEMBERED_LENGTH or name == SPACE:
                out[k] = np.array(self.segment(name, int(keys[k]), threshold), "<i4").tobytes()
        return out.tolist()

    def _courses(self, chunks: list[str], skips: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Numbers of new courses of chunks: these steps are skipped, the last of them just before ``steps``."""
        numbers = np.empty(len(chunks), np.int64)
        order = np.argsort(np.fromiter(map(len, chunks), np.int64, len(chunks)), kind="stable")
        for start in range(0, len(chunks), TOGETHER):
            part = order[start : start + TOGETHER]
            own, own_skips, own_steps, came = [chunks[k] for k in part.tolist()], skips[part], steps[part], []

            def skip(rows: np.ndarray, codes: np.ndarray, step: int) -> np.ndarray:
                later = own_steps[rows] <= step
                came.append((rows[later], codes[later]))
                return own_skips[rows] >> min(step, 63) & 1 > 0

            ids = self._agendas(own, skip)
            rows, codes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*came) if came else ((), ())))
            numbers[part] = self.remembered.add(own, own_skips, own_steps, ids, codes[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(own)))
        return numbers

    def encode_many(self, texts: list[str | None], ids: list, seed: int, dropout: float) -> list[bytes | None]:
        """The texts' ids as little-endian 32-bit integers; every occurrence is drawn."""
        threshold = int(dropout * (1 << 30))
        found: list[bytes | None] = []
        for start in range(0, len(texts), TEXTS):
            some = texts[start : start + TEXTS]
            cut = [CHUNK.findall(" " + t) if t else [] for t in some]
            keys = [keys_of(seed, id_, len(c)) for id_, c in zip(ids[start : start + TEXTS], cut)]
            out = self._segmented([c for x in cut for c in x], np.concatenate(keys), threshold)
            ends = np.cumsum([0, *map(len, cut)]).tolist()
            found += [None if t is None else b"".join(out[a:b]) for t, a, b in zip(some, ends, ends[1:])]
        return found

    def encode(self, text: str, id_: object, seed: int, dropout: float) -> bytes:
        return self.encode_many([text], [id_], seed, dropout)[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]

    def decode_many(self, lists: pa.ListArray) -> pa.Array:
        """``decode`` of many lists; null for null."""
        ids = lists.flatten()
        if ids.null_count:
            raise ValueError("a null id stands for no piece")
        parts = self.parts.take(ids)
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_numpy()])
        offsets = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1) if len(parts) else np.zeros(1, np.int32)
        texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets[ends]), parts.buffers()[2])
        texts.validate(full=True)
        return pc.if_else(lists.is_valid(), pc.utf8_slice_codeunits(texts, 1), None)


def pieces_of(model: bytes) -> Pieces:
    """One table per worker process, kept between tasks."""
    return kept(hashlib.blake2b(model, digest_size=16).digest(), lambda: Pieces(model))


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _broadcast(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ids_column: str = "ids", seed: int = 13,
    dropout: float = 0.1, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """All columns and the ids of the text's pieces."""
    names = [c for c in docs.columns if c != ids_column]
    plain = sealed(docs).select(*[at(docs, c) for c in names])
    at_id, at_text = names.index(id_column), names.index(text_column)
    schema = plain.withColumn("ids", F.lit(None).cast("array<int>")).schema
    model = _broadcast(docs.sparkSession, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = part.column(at_text).to_pylist()
                keys = ["null" if i is None else i for i in part.column(at_id).to_pylist()]
                ids = pieces.encode_many(texts, keys, seed, dropout)
                ends = np.cumsum([0, *[0 if x is None else len(x) // 4 for x in ids]]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in ids], pa.bool_()))
                yield pa.record_batch([*part.columns, lists], names=schema.names)

    return plain.mapInArrow(rows, schema).toDF(*names, ids_column)


def decode(tokens: DataFrame, ids_column: str = "ids", text_column: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns and the text that the ids stand for."""
    names = [c for c in tokens.columns if c != text_column]
    plain = sealed(tokens).select(*[at(tokens, c) for c in names])
    at_ids = names.index(ids_column)
    schema = plain.withColumn("text", F.lit(None).cast("string")).schema
    model = _broadcast(tokens.sparkSession, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield pa.record_batch([*part.columns, pieces.decode_many(part.column(at_ids))], names=schema.names)

    return plain.mapInArrow(rows, schema).toDF(*names, text_column)
