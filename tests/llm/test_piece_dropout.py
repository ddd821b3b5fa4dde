import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from cases import ROWS, odd
from hypothesis import given, settings
from hypothesis import strategies as st

from edaspark.llm import piece_dropout as P
from edaspark.llm.queries import QUERIES

PIECES = P.Pieces(P.read_vocabulary())
OWN = sentencepiece.SentencePieceProcessor(model_file=P.VOCABULARY)


def ids(text, dropout=0.0, id_=1, seed=13):
    return [int.from_bytes(b, "little") for b in zip(*[iter(PIECES.encode(text, id_, seed, dropout))] * 4)]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_round_trip(text):
    for dropout in (0.0, 0.1, 1.0):
        assert PIECES.decode(ids(text, dropout)) == text


@given(st.text(st.sampled_from("abcdefghthe andingé  \n.,ßüñ漢"), min_size=1, max_size=80))
@settings(max_examples=300, deadline=None)
def test_without_dropout_as_the_library(text):
    assert ids(text) == OWN.encode(text)


def test_library_on_documents(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    for text in texts[:60]:
        assert ids(text) == OWN.encode(text)


@given(st.lists(st.text(st.sampled_from("abcdefghthe andingé&*.ßüñ漢\U0001f600\x00"), min_size=1, max_size=32), min_size=1, max_size=20), st.integers(0, (1 << 30) - 1))
@settings(max_examples=200, deadline=None)
def test_many_as_one_by_one(chunks, key):
    keys = np.array([(key * (k + 1)) % (1 << 30) for k in range(len(chunks))])
    for threshold in (0, 1 << 27, 1 << 30):
        many = PIECES.segment_many(chunks, keys, threshold)
        assert [np.frombuffer(x, "<i4").tolist() for x in many] == [PIECES.segment(c, int(k), threshold) for c, k in zip(chunks, keys)]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{k * j % 97}ing" for k in range(50)) for j in range(20)]
    plain = P.Pieces(P.read_vocabulary()).encode_many(texts, range(20), 3, 0.2)
    monkeypatch.setattr(P, "REMEMBERED", 5)
    pieces = P.Pieces(P.read_vocabulary())
    assert [pieces.encode(t, i, 3, 0.2) for i, t in enumerate(texts)] == plain


def slow_encode(text, id_, seed, dropout):
    """Merge-dropout stated apart from the module: all adjacent pairs are looked at anew after every merge."""
    if not text:
        return []
    mask, out = (1 << 30) - 1, []
    chunks = P.CHUNK.findall(" " + text)
    for chunk, key in zip(chunks, P.keys_of(seed, id_, len(chunks)).tolist()):
        parts, gone = [(i, c.replace(" ", P.SPACE)) for i, c in enumerate(chunk)], set()
        while chunk != P.SPACE:
            pairs = []
            for (i, a), (j, b) in zip(parts, parts[1:]):
                known = OWN.piece_to_id(a + b)
                if known != OWN.unk_id() and OWN.id_to_piece(known) == a + b and (i, a, b) not in gone:
                    pairs.append((-OWN.get_score(known), i, known, a, b))
            if not pairs:
                break
            _, i, known, a, b = min(pairs)
            code = (zlib.crc32(b"%d" % known) >> 2) ^ (i * 0x27D4EB2F)
            if (((key ^ code) & mask) * 0x2C1B3C6D >> 11) & mask < int(dropout * (1 << 30)):
                gone.add((i, a, b))
                continue
            at_ = [p for p, _ in parts].index(i)
            parts[at_ : at_ + 2] = [(i, a + b)]
        for _, part in parts:
            known = OWN.piece_to_id(part)
            whole = chunk != P.SPACE and known != OWN.unk_id() and OWN.id_to_piece(known) == part
            out += [known] if whole else [OWN.piece_to_id(f"<0x{b:02X}>") for b in part.encode()]
    return out


@given(st.text(st.sampled_from("abcdefghthe andingé  \n.,ßüñ漢\u2581"), max_size=80), st.integers(0, 9), st.sampled_from([0.0, 0.1, 0.5]))
@settings(max_examples=300, deadline=None)
def test_against_slow_dropout(text, id_, dropout):
    assert ids(text, dropout, id_) == slow_encode(text, id_, 13, dropout)


def test_documents_against_slow_dropout(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(12).collect()
    for r in rows:
        assert ids(r.text[:3000], 0.1, r.doc_id) == slow_encode(r.text[:3000], r.doc_id, 13, 0.1)


def test_variation():
    text = "information retrieval systems understand complicated questions"
    plain = ids(text)
    found = {tuple(ids(text, 0.3, id_)) for id_ in range(50)}
    assert len(found) > 10
    assert any(list(x) != plain for x in found)
    assert ids(text, 0.3, 5) == ids(text, 0.3, 5)
    assert {tuple(ids(text, 0.3, 5, seed)) for seed in range(20)} != {tuple(ids(text, 0.3, 5))}
    characters = ids(text, 1.0)
    assert len(characters) == len(text) + 1  # every merge skipped


def test_share_of_skipped_merges():
    """Merges that a first agenda offers are skipped at about the dropout rate."""
    taken = [len(PIECES.segment(" th", zlib.crc32(b"%d" % key) >> 2, int(0.25 * (1 << 30)))) for key in range(4000)]
    whole = sum(n == 1 for n in taken) / len(taken)
    assert 0.5 < whole < 0.8


def test_odd_rows(spark):
    tokens = P.encode(odd(spark), dropout=0.2)
    assert set(tokens.columns) == set(odd(spark).columns)
    back = P.decode(tokens)
    assert sorted(((r.doc_id, r.decoded) for r in back.collect()), key=repr) == sorted(ROWS, key=repr)
    assert sorted(len(r.ids) for r in tokens.filter("doc_id = 4").collect()) == [0]
    assert tokens.filter("doc_id = 3").first().ids is None


def test_empty(spark):
    assert P.decode(P.encode(odd(spark, []))).count() == 0


def test_query(spark, folder):
    found = QUERIES["op6_piece_dropout"](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert found.filter("not lossless").count() == 0


def test_every_occurrence_draws():
    """One word many times in a text: far more than four segmentations, each that of its own key."""
    word = " understanding"
    texts = [word[1:] + word * 1999, None, ""]
    pieces = P.Pieces(P.read_vocabulary())
    threshold = int(0.3 * (1 << 30))
    found = pieces.encode_many(texts, [7, 8, 9], 13, 0.3)
    want = [tuple(pieces.segment(word, int(k), threshold)) for k in P.keys_of(13, 7, 2000)]
    assert np.frombuffer(found[0], "<i4").tolist() == [i for x in want for i in x]
    assert len(set(want)) > 20
    assert found[1:] == [None, b""]
    assert pieces.encode_many(texts, [7, 8, 9], 13, 0.3) == found


def test_merges_that_never_come_up_are_not_told_apart(monkeypatch):
    """Occurrences that skip other merges, but none that comes up, are segmented once (1706 were here before)."""
    word, pieces, seen = " understanding", P.Pieces(P.read_vocabulary()), []
    name = "_agendas" if hasattr(pieces, "_agendas") else "segment_many"
    plain = getattr(pieces, name)
    monkeypatch.setattr(pieces, name, lambda chunks, *rest: seen.extend(chunks) or plain(chunks, *rest))
    found = pieces.encode(word[1:] + word * 1999, 7, 13, 0.1)
    want = [i for key in P.keys_of(13, 7, 2000) for i in pieces.segment(word, int(key), int(0.1 * (1 << 30)))]
    assert np.frombuffer(found, "<i4").tolist() == want
    assert len(seen) < 500


def test_unknown_characters_many_at_a_time(monkeypatch):
    """Short chunks with characters outside the vocabulary are not segmented one by one."""
    text = "\U0001f600the\U0001f601 \u0378x and\U0001f600 " * 3
    want = slow_encode(text, 1, 13, 0.3)
    monkeypatch.setattr(P.Pieces, "segment", None)
    assert ids(text, 0.3) == want


@pytest.mark.parametrize("name, value", [("STEPS", 2), ("REMEMBERED", 1), ("REMEMBERED_LENGTH", 3), ("TOGETHER", 3)])
def test_limits_change_nothing(monkeypatch, name, value):
    monkeypatch.setattr(P, name, value)
    texts = [" ".join(f"understanding w{k * j % 7}ing a the" for k in range(20)) for j in range(4)]
    for dropout in (0.1, 0.6, 1.0):
        found = P.Pieces(P.read_vocabulary()).encode_many(texts, range(4), 3, dropout)
        assert [np.frombuffer(x, "<i4").tolist() for x in found] == [slow_encode(t, i, 3, dropout) for i, t in enumerate(texts)]


def test_pairs_of_the_table():
    """Every pair has its number and no other has one, also where long rows leave little room."""
    random = np.random.default_rng(1)
    for n, share in ((40, 0.9), (300, 0.1), (7, 0.0)):
        table = random.random((n, n)) < share
        left, right = np.nonzero(table)
        merges = P.Merges(left, right, left * n + right, n + 1)
        a, b = (x.ravel() for x in np.indices((n + 1, n + 1)))
        known = np.zeros((n + 1, n + 1), bool)
        known[:n, :n] = table
        assert merges.find(a, b).tolist() == np.where(known.ravel(), a * n + b, P.NO_MERGE).tolist()


def test_decode_many():
    texts = ["a the  \u2581\U0001f600", None, "", "\n\u00e9", " b", None]
    lists = pa.array([None if t is None else ids(t, 0.5) for t in texts], pa.list_(pa.int32()))
    for start in range(len(texts) + 1):
        for length in range(len(texts) - start + 1):
            assert PIECES.decode_many(lists.slice(start, length)).to_pylist() == texts[start : start + length]
    with pytest.raises(ValueError):
        PIECES.decode_many(pa.array([[5, None]], pa.list_(pa.int32())))
    with pytest.raises(pa.ArrowInvalid):  # bytes that are no text
        PIECES.decode_many(pa.array([[5, PIECES.byte_ids[0xFF]]], pa.list_(pa.int32())))
