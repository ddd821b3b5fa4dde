import hashlib
import random
import zlib

import pytest
from cases import ROWS, odd, rows_of

from edaspark.llm import repeat_spans as R
from edaspark.llm.queries import QUERIES


def model(rows, length=100):
    """By a set of all strings met so far."""
    low = lambda i: -(1 << 63) if i is None else i
    import xxhash

    signed = lambda h: h - (h >> 63 << 64)
    data = [((t or "").encode(), i) for i, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (low(data[k][1]), signed(xxhash.xxh64_intdigest(data[k][0], 42))))
    seen, out = set(), []
    for k in order:
        text, i = data[k]
        covered = bytearray(len(text))
        for p in range(len(text) - length + 1):
            s = text[p : p + length]
            if s in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, c in zip(text, covered) if not c)
        runs = sum(c and not (p and covered[p - 1]) for p, c in enumerate(covered))
        out.append((i, len(text), len(text) - len(kept), runs, kept))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    rows = [*ROWS, (20, ROWS[8][1][500:900]), (20, "x" * 400), (21, "ab" * 300), (None, "x" * 150), (30, ROWS[8][1])]
    assert found(R.remove_repeats(odd(spark, rows))) == model(rows)


def _of_crc32(text, target):
    """The text with some letters at its end changed so that its crc32 is the target's: a linear map, solved bit by bit."""
    data, places = bytearray(text), [(k, b) for k in range(len(text) - 40, len(text)) for b in (0, 1)]
    base = zlib.crc32(bytes(data))
    rows_ = []
    for k, b in places:
        flipped = bytearray(data)
        flipped[k] ^= 1 << b
        rows_.append((zlib.crc32(bytes(flipped)) ^ base, {(k, b)}))
    left, chosen, pivots = base ^ target, set(), []
    for value, own in rows_:
        for top, v, o in pivots:
            if value >> top & 1:
                value, own = value ^ v, own ^ o
        if value:
            pivots.append((value.bit_length() - 1, value, own))
    for top, v, o in sorted(pivots, key=lambda p: -p[0]):
        if left >> top & 1:
            left, chosen = left ^ v, chosen ^ o
    assert left == 0
    for k, b in chosen:
        data[k] ^= 1 << b
    return bytes(data)


def test_equal_checksums_and_ids(spark):
    """Different texts of one id, or without an id, whose crc32 agrees: none is a copy of another."""
    rng = random.Random(2)
    one = "".join(rng.choice("abcdefghijklm") for _ in range(138))
    two = _of_crc32("".join(rng.choice("PQRSTUVW") for _ in range(138)).encode(), zlib.crc32(one.encode())).decode()
    assert zlib.crc32(one.encode()) == zlib.crc32(two.encode()) and not set(one) & set(two)
    for id_ in (None, 5):
        rows = [(id_, one), (id_, two), (id_, one)]
        got = found(R.remove_repeats(odd(spark, rows)))
        assert got == model(rows) and sorted(n for _, _, n, _, _ in got)[-1] == 138 and sum(n > 0 for _, _, n, _, _ in got) == 1


def test_empty(spark):
    assert R.remove_repeats(odd(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_random_pieces(spark, seed):
    """Passages around the threshold, edited copies, periodic texts, low alphabets."""
    rng = random.Random(seed)
    alphabet = ["ab", "abcdefgh ", "aé漢z", "".join(map(chr, range(32, 127)))][seed]
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(n) for n in (60, 98, 99, 100, 101, 102, 130, 168, 169, 250, 400)]
    base = text(900)
    rows = []
    for k in range(60):
        parts = [rng.choice((rng.choice(passages), text(rng.randint(0, 150)), rng.choice(passages)[: rng.randint(50, 200)])) for _ in range(rng.randint(1, 5))]
        rows.append((rng.choice((k, k, k // 2)), "".join(parts)))
    for k in range(15):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(alphabet)
        rows.append((200 + k, "".join(copy)))
    rows += [(300, "na" * 200), (301, "q" + "na" * 200), (302, "".join(passages) * 2)]
    assert found(R.remove_repeats(odd(spark, rows))) == model(rows)


def test_long_text_in_parts(monkeypatch):
    """Windows over parts of a long text are the same as over the whole."""
    rng = random.Random(9)
    text = bytes(rng.choice(b"abc ") for _ in range(5000))
    whole = R.segments([text])
    assert sum(e - s - 99 for s, e in zip(whole[3], whole[4])) == len(text) - 99
    monkeypatch.setattr(R, "CHUNK", 700)
    parts = R.segments([b"zz", text, None, text[:300]])
    own = parts[2] == 1
    spans = sorted(zip(parts[3][own], parts[4][own]))
    assert [p for s, e in spans for p in range(s, e - 99)] == list(range(len(text) - 99))
    anchors = lambda x, of: {p: a for s, e, o in zip(x[3][of], x[4][of], x[5][of]) for p in range(s, e - 99) for a in [s + o]}
    assert anchors(parts, own) == anchors(whole, slice(None))


def test_groups_across_batches():
    """Sorted rows judged alike whatever the batches."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randrange(12), rng.randrange(3), rng.randrange(3), 0, rng.randrange(4), 100, rng.choice((0, 0, 0, -1))) for _ in range(200))
    names = ["k", "full", "id", "tie", "start", "end", "off"]
    types = [pa.int64()] * 3 + [pa.int32()] * 4

    def run(size):
        batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), types)], names=names) for i in range(0, len(rows), size)]
        return sorted(tuple(r.values()) for b in R._judge(iter(batches)) for r in b.to_pylist())

    assert run(200) == run(1) == run(7)
    want = []
    for r in (r for r in rows if r[6] < 0):
        want.append((*r[2:], True))
    real = [r for r in rows if r[6] >= 0]
    for r in real:
        group = [x for x in real if x[:2] == r[:2]]
        if r[2:5] != min(group)[2:5]:
            want.append((*r[2:], True))
    firsts = {r[:2]: min(x for x in real if x[:2] == r[:2]) for r in real}
    for (k, f), r in firsts.items():
        if sum(x[0] == k for x in firsts) > 1:
            want.append((*r[2:], False))
    assert run(50) == sorted(want)
    assert np.all(True)


def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op7_repeated_bytes"](spark, folder))
    assert got == [(i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in model(docs)]
    assert any(r[2] for r in got)
