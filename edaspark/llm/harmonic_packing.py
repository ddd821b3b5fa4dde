"""Token sequences of bounded length, packed by reciprocal-capacity classes.

A piece of r tokens is of class k = capacity // r, so k pieces of the class fit one sequence, and each sequence of the
class takes exactly k pieces: no sizes are compared and no worker needs another. Documents are cut so that classes fill well: whole
sequences first (class 1); a rest within 1 / ``slack`` of its class' share capacity // k, or below ``grain``, stays whole; of any other
rest the next class' share is cut off exactly, and what is left is treated likewise. Shares shrink fast, so cuts are few.

Tasks pack what they read, without a shuffle. What a task has left over at its end, fewer than k pieces of each class, is
packed by falling size wherever there is room, and sequences still not full are cut into powers of two, which need no padding. A sequence's
id is the number of its partition and of the sequence in it; the scan of the same files gives the same ids again.

Ids are those of a tokenizer file, without special tokens added, then ``end_id``: every document, empty or null too, has one id at least.
Every row is a document of its own, whatever its id. An empty table gives no rows. A task holds the ids of one batch of texts, or of one longer text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import identified

VOCABULARY = "byte_bpe_50k.json"
# Characters of text that are encoded together.
BATCH_CHARS = 1 << 20
# Bits of a sequence's id that number it inside its partition.
WITHIN = 40


def cut(n: int, capacity: int, grain: int, slack: int) -> Iterator[int]:
    """Lengths of the pieces of n tokens, in order."""
    yield from [capacity] * (n // capacity)
    n %= capacity
    while n:
        share = capacity // (capacity // n)
        if n < grain or (share - n) * slack <= share:
            yield n
            return
        share = capacity // (capacity // n + 1)
        yield share
        n -= share


class Packer:
    """Open sequences of every class; pieces are (length, tag)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def add(self, length: int, tag) -> list | None:
        """The pieces of the sequence that this one completes."""
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((length, tag))
        return self.open.pop(k) if len(held) == k else None

    def rest(self) -> list[list]:
        """Sequences of all pieces left, by falling size, each to the first sequence with room."""
        pieces = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[0])
        self.open = {}
        made: list[list] = []
        room: list[int] = []
        for piece in pieces:
            k = next((k for k, r in enumerate(room) if r >= piece[0]), len(room))
            if k == len(room):
                made.append([])
                room.append(self.capacity)
            made[k].append(piece)
            room[k] -= piece[0]
        return made


def split_in_powers(lengths: list[int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of power-of-two lengths, as (piece, first token in it, length), from the pieces of one sequence."""
    out, total, k, done = [], sum(lengths), 0, 0
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            take = min(room, lengths[k] - done)
            part.append((k, done, take))
            room, done = room - take, done + take
            if done == lengths[k]:
                k, done = k + 1, 0
        out.append(part)
    return out


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it prints, else the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """What encodes texts under a tokenizer file.

    A byte-level file whose ids follow its merges says the same as a table of ranks, for which there is a faster
    engine with the same ids; any other file is left to its own.
    """
    about = json.loads(Path(path).read_text())
    model, before = about["model"], about["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    plain = plain and about["normalizer"] is None and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
    if plain:
        special = {t["content"]: t["id"] for t in about["added_tokens"]}
        letters = _bytes_of_letters()
        ranks = {bytes(map(letters.__getitem__, w)): k for w, k in model["vocab"].items() if w not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged)
    if plain:
        import tiktoken

        engine = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: (engine.encode_to_numpy(t, allowed_special="all") for t in texts)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    engine = Tokenizer.from_file(path)
    return lambda texts: (np.array(found.ids, "<u4") for found in engine.encode_batch(texts, add_special_tokens=False))


def encoded(texts: list[str | None], path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text and the end id, as little-endian unsigned 32-bit numbers."""
    encode, a = encoder(path), 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= BATCH_CHARS):
            size += len(texts[b] or "")
            b += 1
        for ids in encode([t or "" for t in texts[a:b]]):
            yield np.append(ids, end_id).astype("<u4")
        a = b


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, vocabulary: str | None = None,
    end_id: int = 1, grain: int = 64, slack: int = 64,
) -> DataFrame:
    """(id, start, length, ids: little-endian unsigned 32-bit numbers, doc_tokens, sequence_id, offset) of every piece."""
    texts = identified(docs, id_column, text_column).select("_id", "_text")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = texts.schema["_id"].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = Packer(capacity), TaskContext.get().partitionId() << WITHIN
        out: list[tuple] = []
        id_type = None

        def close(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for length, (id_, start, ids, total) in pieces:
                out.append((id_, start, length, ids.tobytes(), total, sequence, offset))
                offset += length
            sequence += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for id_, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), path, end_id)):
                start = 0
                for length in cut(len(ids), capacity, grain, slack):
                    full = packer.add(length, (id_, start, ids[start : start + length].copy(), len(ids)))
                    start += length
                    if full:
                        close(full)
                if len(out) >= 1 << 14:
                    yield flushed()
        for pieces in packer.rest():
            lengths = [length for length, _ in pieces]
            if sum(lengths) == capacity:
                close(pieces)
                continue
            for part in split_in_powers(lengths):
                tags = [(pieces[k][1], a, length) for k, a, length in part]
                close([(length, (t[0], t[1] + a, t[2][a : a + length], t[3])) for t, a, length in tags])
        if out:
            yield flushed()

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return texts.mapInArrow(rows, schema).toDF(id_column, *names[1:])
