import re
import zlib
from collections import Counter

import numpy as np
from cases import ROWS, odd, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from edaspark.llm import quality_rules as Q
from edaspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@given(st.lists(st.sampled_from(["a", "b", "cé", "#x", "\n", "\t", " ", "\x1c", "  "]), max_size=60))
@settings(max_examples=400, deadline=None)
def test_counts(parts):
    text = " ".join(parts)
    data = text.encode()
    words = data.split()
    assert Q.base_counts(data, words, Q.numbered(words)[0]) == counts(text)


def slow_buckets(words):
    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = [(zlib.crc32(w) + 1) * mix & mask for w in words]
    pairs = [((a >> 29) ^ b) * mix & mask for a, b in zip(h, h[1:])]
    return [x >> 48 for x in h + pairs]


def slow_ratios(rows, trusted):
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for i, t in rows:
        for b in slow_buckets((t or "").encode().split()):
            raw[b] += 1
            target[b] += i in trusted
    return raw, target


LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 0), (6, 1, 0), (7, 1, 1), (None, 1, 0), (8, None, 0), (9, 1, None)]


def test_odd_rows(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    raw, target = Q.count_ngrams(odd(spark), labels)
    want = slow_ratios(ROWS, {1, 6, 9})
    assert (raw == want[0]).all() and (target == want[1]).all()
    ratios = Q.log_ratios(raw, target)
    found = rows_of(Q.judge(odd(spark), ratios, threshold=0.1))
    slow = []
    for i, t in ROWS:
        c = counts(t)
        b = slow_buckets((t or "").encode().split())
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        ratio = float(np.mean(ratios[b])) if b else None
        slow.append((i, *c, failed, ratio, not failed and (ratio is None or ratio >= 0.1)))
    slow.sort(key=repr)
    assert [x[:7] + x[8:] for x in found] == [x[:7] + x[8:] for x in slow]
    assert np.allclose([x[7] or 0 for x in found], [x[7] or 0 for x in slow])


def test_without_trusted(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    raw, target = Q.count_ngrams(odd(spark), none)
    assert Q.log_ratios(raw, target) is None
    found = Q.judge(odd(spark), None)
    assert found.filter("kept = base_failed or ratio is not null").count() == 0
    assert Q.judge(odd(spark, []), None).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op2_ngram_ratio"](spark, folder).toPandas().set_index("doc_id")
    assert len(found) == len(docs)
    for i, t in docs:
        r = found.loc[i]
        c = counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    passed = found[~found.base_failed].join(labels, how="inner")
    assert passed[passed.quality == 1].kept.mean() > 0.99
    assert passed[passed.quality == 0].kept.mean() < 0.2


def test_all_trusted_documents_teach(spark):
    """More trusted ids than any sample held, and as many by the shuffled join."""
    n = 17_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 7) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality")
    raw, target = Q.count_ngrams(docs, labels)
    assert raw.sum() == target.sum() == n
    again = Q.count_ngrams(docs, labels, broadcast=0)
    assert (again[0] == raw).all() and (again[1] == target).all()
