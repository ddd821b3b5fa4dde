import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import ROWS, odd, rows_of

from edaspark.llm import spelling_variants as S
from edaspark.llm.queries import QUERIES

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows, misspell=97, min_chars=5, min_count=3):
    counts = Counter()
    for id_, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{id_}:{run}".encode())
            if id_ is not None and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def slow_groups(counts):
    near = defaultdict(set)
    without = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            without[i, cut].add(w)
            if cut in counts:
                near[w].add(cut)
                near[cut].add(w)
    for group in without.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=repr)


def groups(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return rows_of(S.spelling_groups(frame))


@pytest.mark.parametrize("seed", range(4))
def test_random_words(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(S, "PART", rng.choice([2, 4096]))
    letters = ["ab", "abc\u00e9", "abcdefghijklmnopqrstuvwxyz\u00c0\u00d7\u00f7\u00ff", "xyz"][seed]
    least = rng.choice([1, 4, 5])
    counts = {}
    for _ in range(250):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(least, least + 5)))
        counts[word] = rng.choice([3, 3, 4, 9, 20, 300])
        for _ in range(2):
            if not word:
                break
            i = rng.randrange(len(word))
            word = word[:i] + rng.choice(["", word[i], rng.choice(letters) + word[i], rng.choice(letters)]) + word[i + 1 :]
            if len(word) >= least:
                counts.setdefault(word, rng.choice([3, 5, 50]))
    assert groups(spark, counts) == slow_groups(counts)


def test_long_words(spark, monkeypatch):
    monkeypatch.setattr(S, "LONG", 12)
    rng = random.Random(9)
    counts = {"a" * k: k for k in (5, 6, 10, 11, 12, 13, 14, 15, 300, 301)}
    for size in (11, 12, 13, 14, 5000):
        word = "".join(rng.choice("abcd") for _ in range(size))
        for w in (word, word[:-1], "z" + word, word[:3] + "q" + word[4:], word[:3] + "r" + word[4:], word[:4] + "zz" + word[5:]):
            counts[w] = rng.randint(3, 99)
    assert groups(spark, counts) == slow_groups(counts)


def test_one_prefix_holds_all(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 3)
    counts = {f"common{a}{b}": 3 + (a == b) * 9 for a in "abcdefgh" for b in "abcdefgh"}
    assert groups(spark, counts) == slow_groups(counts)


def test_query_against_model(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_spelling_variants"](spark, folder)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = slow_groups(slow_counts(docs))
    assert rows_of(got) == want
    assert sum(w[1] is not None for w in want) > 100 and any(w[1] != w[2] for w in want if w[1])


def test_odd_rows(spark):
    rows = [*ROWS, (10, "\u00c9t\u00c9t\u00e9 etete_Etete etete"), (None, "etetes etetes etetes")]
    counts = S.word_counts(odd(spark, rows), misspell=2)
    want = slow_counts(rows, 2)
    assert dict(rows_of(counts)) == want
    assert rows_of(S.spelling_groups(counts)) == slow_groups(want)
    assert rows_of(S.spelling_groups(S.word_counts(odd(spark, [])))) == []
    again = spark.createDataFrame([("house", 3), (None, 5), ("house", 4), ("horse", 14)], "word string, n long")
    assert rows_of(S.spelling_groups(again)) == [("horse", None, "horse", 14, 1, None), ("house", "horse", "horse", 7, 1, 14)]
