import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edaspark.llm import harmonic_packing as H
from edaspark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@given(st.integers(0, 20000), st.sampled_from([16, 1000, 2048]), st.sampled_from([1, 8, 64]), st.sampled_from([1, 8, 64, 1000]))
@settings(max_examples=500, deadline=None)
def test_cut(n, capacity, grain, slack):
    pieces = list(H.cut(n, capacity, grain, slack))
    assert sum(pieces) == n and all(0 < p <= capacity for p in pieces)
    assert len(pieces) <= n // capacity + 12
    for p in pieces:  # small, or close to its class' share
        share = capacity // (capacity // p)
        assert p < grain or (share - p) * slack <= share


@given(st.lists(st.integers(1, 2048), max_size=300))
@settings(max_examples=200, deadline=None)
def test_classes_take_a_fixed_count(lengths):
    packer, whole = H.Packer(2048), []
    for k, n in enumerate(lengths):
        full = packer.add(n, k)
        if full:
            classes = {2048 // p for p, _ in full}
            assert len(classes) == 1 and len(full) == classes.pop() and sum(p for p, _ in full) <= 2048
            whole += full
    for part in packer.rest():
        assert sum(p for p, _ in part) <= 2048
        whole += part
    assert sorted(whole, key=lambda p: p[1]) == [(n, k) for k, n in enumerate(lengths)]


@given(st.lists(st.integers(1, 200), min_size=1, max_size=10))
@settings(max_examples=200, deadline=None)
def test_powers(lengths):
    parts = H.split_in_powers(lengths)
    for part in parts:
        n = sum(length for _, _, length in part)
        assert n & (n - 1) == 0
    flat = [p for part in parts for p in part]
    for k, n in enumerate(lengths):
        own = [(a, length) for j, a, length in flat if j == k]
        assert own[0][0] == 0 and sum(length for _, length in own) == n
        assert all(a + length == b for (a, length), (b, _) in zip(own, own[1:]))


@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(["<|endoftext|>", "  \n\n x", "it's 12\u00a0\u2028", "\u0130\u4e00a\u0301", "'LL \t"])), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(parts):
    text = "".join(parts)
    (ids,) = H.encoded([text], PATH, 1)
    assert ids.tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]


def test_other_files_are_left_to_their_own_engine():
    path = public_tokenizers.path("word_bpe_49k.json")
    (ids,) = H.encoded(["Some words here"], path, 7)
    assert ids.tolist() == [*Tokenizer.from_file(path).encode("Some words here", add_special_tokens=False).ids, 7]


def check(pieces, texts, padding):
    """pieces: (doc, start, length, crc32, doc_tokens, sequence, offset); texts by doc."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        of_doc[doc].append((start, length, crc, total))
        of_sequence[sequence].append((offset, length))
    assert set(of_doc) == set(texts)
    for doc, own in of_doc.items():
        ids = np.array([*TOKENIZER.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        place = 0
        for start, length, crc, total in sorted(own):
            assert start == place and length > 0 and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            place += length
        assert place == len(ids)
    padded = filled = 0
    for own in of_sequence.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= 2048
        filled += place
        padded += 0 if place & (place - 1) == 0 else 2048 - place
    assert padded <= padding * filled


@pytest.mark.parametrize("parts", [1, 3])
def test_query(spark, folder, parts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    if parts == 1:
        got = QUERIES["op12_harmonic_packing"](spark, folder)
        assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        again = QUERIES["op12_harmonic_packing"](spark, folder)
        assert sorted(got.collect()) == sorted(again.collect())
        check([tuple(r) for r in got.collect()], texts, 0.01)
        return
    got = H.pack(docs.repartition(parts)).collect()
    check([(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in got], texts, 0.01)


def test_odd_rows(spark):
    rows = [(k, *r[1:]) for k, r in enumerate(ROWS)] + [(100, "a <|endoftext|> inside"), (101, None)]
    got = H.pack(odd(spark, rows)).collect()
    check([(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in got], dict(rows), 0.01)
    # Null and repeated ids: every row is packed.
    assert sum(r.start == 0 for r in H.pack(odd(spark)).collect()) == len(ROWS)
    assert H.pack(odd(spark, [])).collect() == []
