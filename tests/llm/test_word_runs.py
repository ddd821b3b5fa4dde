import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import LONG, ROWS, odd, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from edaspark.llm import word_runs as W
from edaspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=12):
    """All maximal stretches of every period, the smallest period of each kept."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def slow_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, n):
    words = []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.5:
            p = rng.choice([1, 2, 3, 5, 6, 7, 8, 13, 14, 15, 16, 29, 30, 31, 33, 62, 63, 70])
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(p)]
            words += (unit * 9)[: rng.randint(p, 6 * p + 12)]
        else:
            words += [str(rng.randrange(50)) for _ in range(rng.randint(1, 30))]
    return words[:n]


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_all_periods(seed):
    rng = random.Random(seed)
    texts = [periodic(rng, rng.choice([0, 1, 11, 12, 13, 40, 150, 400])) for _ in range(4)]
    found = list(W.runs_of_texts([" ".join(t).encode() for t in texts]))
    for words, (n, runs, short) in zip(texts, found):
        want = slow_runs(words)
        assert (n, [tuple(r) for r in runs.tolist()]) == (len(words), want)
        assert short.decode() == slow_collapsed(words, want)


@given(st.lists(st.sampled_from("aab"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_few_letters(words):
    ((_, runs, _),) = W.runs_of_texts([" ".join(words).encode()])
    assert [tuple(r) for r in runs.tolist()] == slow_runs(words)


@pytest.mark.parametrize("q", [*range(1, 70), 127, 128, 255])
def test_shortest_runs_of_every_period(q):
    for shift in range(0, 16, 3):
        unit = [f"u{k}" for k in range(q)]
        words = [f"x{k}" for k in range(shift)] + (unit * 13)[: max(12, 2 * q)] + ["y"]
        ((_, runs, _),) = W.runs_of_texts([" ".join(words).encode()])
        assert runs.tolist() == [[shift, max(12, 2 * q), q]]


def test_convolution_is_exact():
    rng = np.random.default_rng(3)
    for block, low, high in ((4, 1, 14), (8, 15, 30), (64, 127, 254), (1 << 12, 8191, 16382)):
        fold = int(((W.PRIME - 1) // block) ** 0.5)
        values = rng.integers(0, fold, 40000).astype(np.uint64)
        values[rng.integers(0, 40000, 9000)] = fold - 1
        starts = np.array([0, 5, 17000])
        got = W.mismatches(values, starts, block, low, high)
        plain = values.astype(np.int64)
        for k, a in enumerate(starts):
            for q in (low, low + 3, high):
                assert got[k, q - low] == ((plain[a : a + block] - plain[a + q : a + q + block]) ** 2).sum()


def test_folded_numbers_are_verified(monkeypatch):
    # Numbers folded to two values match where words differ; the extension tells.
    monkeypatch.setattr(W, "PRIME", 97)
    words = periodic(random.Random(5), 300)
    monkeypatch.setattr(W, "mismatches", lambda values, starts, block, low, high: np.zeros((len(starts), high - low + 1), np.int64))
    ((_, runs, _),) = W.runs_of_texts([" ".join(words).encode()])
    assert [tuple(r) for r in runs.tolist()] == slow_runs(words)


def test_long_repeated_text_is_one_run():
    words = [f"w{k}" for k in range(30011)]
    text = " ".join(words * 2 + words[:100]).encode()
    ((n, runs, short),) = W.runs_of_texts([text])
    assert (n, runs.tolist()) == (60122, [[0, 60122, 30011]])
    assert short == " ".join(words).encode()


def digests(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = slow_runs(words) if n < 3000 else None
    return words, runs


def wanted(doc_id, text):
    words, runs = digests(doc_id, text)
    if runs is None:
        return None
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha(lines), sha(slow_collapsed(words, runs))


def test_query_against_model(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_word_runs"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in got.collect()}
    assert set(got) == set(docs)
    want = {i: wanted(i, t) for i, t in docs.items()}
    assert all(got[i] == w for i, w in want.items() if w is not None)
    assert sum(w is not None and w[1] > 0 for w in want.values()) >= len(docs) // 15


def test_odd_rows(spark):
    found = W.periodic_runs(odd(spark))
    assert found.columns == [*odd(spark).columns, "n_words", "runs", "collapsed"]
    got = rows_of(found.select("doc_id", "text", "n_words", "runs", "collapsed"))
    assert len(got) == len(ROWS)
    for _, text, n, runs, short in got:
        words = WORD.findall(text or "")
        want = slow_runs(words) if text != LONG else [tuple(r) for r in runs]
        assert n == len(words) and [tuple(r) for r in runs] == want and short == slow_collapsed(words, want)
    again = W.periodic_runs(found)
    assert again.columns == found.columns
    assert rows_of(W.periodic_runs(odd(spark, []))) == []
    replay = rows_of(W.replayed(odd(spark)).select("doc_id", "text"))
    assert len(replay) == len(ROWS) and sum(i is None for i, _ in replay) == 2
    for i, text in replay:
        if zlib.crc32(str(i).encode()) % 10 and text and text != LONG:
            assert (i, text) in [r[:2] for r in ROWS]
