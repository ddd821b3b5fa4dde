import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import ROWS, odd, rows_of

from edaspark.llm import lm_scoring as M
from edaspark.llm.common import fold_of
from edaspark.llm.queries import QUERIES


class Slow:
    """The model by dictionaries and its definition."""

    def __init__(self, texts, order, max_nodes):
        self.order = order
        counts, totals, positions = Counter(), Counter(), 0
        for t in texts:
            data = bytes([10]) * order + t + bytes([10])
            for i in range(order, len(data)):
                positions += 1
                for k in range(order + 1):
                    counts[data[i - k : i + 1]] += 1
                    totals[data[i - k : i]] += 1
        least = max(1, -(-positions // max_nodes))
        self.next = defaultdict(dict)
        for gram, n in counts.items():
            if n >= least:
                self.next[gram[:-1]][gram[-1]] = n
        self.totals = totals

    def probability(self, context, byte):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            own = context[len(context) - k :]
            if own not in self.next:
                continue
            known = {b: n for b, n in self.next[own].items() if b not in excluded}
            total = self.totals[own] - sum(n for b, n in self.next[own].items() if b in excluded)
            if total:
                if byte in known:
                    return p * (known[byte] - 0.5) / total
                p *= (total - sum(known.values()) + len(known) / 2) / total
            excluded |= set(known)
        return p / (256 - len(excluded))

    def score(self, text):
        data = bytes([10]) * self.order + text + bytes([10])
        return sum(math.log10(self.probability(data[i - self.order : i], data[i])) for i in range(self.order, len(data)))


def words(text):
    return M.canonical((text or "").encode())


def model(rows, order, max_nodes, taught):
    train = [words(t) for i, t in rows if taught(i)]
    counts = Counter(w for t in train for w in t) + Counter({b"\n": len(train)})
    n, v = sum(counts.values()), len(counts)
    slow = Slow([b" ".join(t) for t in train], order, max_nodes)
    out = []
    for i, t in rows:
        tokens = [*words(t), b"\n"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, slow.score(b" ".join(tokens[:-1]))))
    return sorted(out, key=repr)


def same(found, want):
    assert [x[:4] for x in found] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in found], [x[4:] for x in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order,max_nodes,hot", [(3, 1 << 20, 1 << 16), (2, 40, 3), (6, 300, 1)])
def test_against_dictionaries(spark, monkeypatch, order, max_nodes, hot):
    rng = random.Random(1)
    rows = [r if r[0] != 6 else (6, r[1][:3000]) for r in ROWS]
    rows += [(100 + k, " ".join(rng.choice(("The", "cat", "sät", "on", "mat", "\x00", "x" * 70)) for _ in range(30))) for k in range(12)]
    taught = lambda i: i is None or i % 3 != 0
    training = M.F.col("_id").isNull() | (M.F.col("_id") % 3 != 0)
    found = M.score_documents(odd(spark, rows), training, order=order, max_nodes=max_nodes, hot=hot)
    same(rows_of(found), model(rows, order, max_nodes, taught))


def test_probabilities_sum_to_one():
    texts = [b"the cat sat on the mat", b"the rat sat", b"a cat", b""]
    for order, max_nodes in ((3, 1 << 20), (4, 20)):
        slow = Slow(texts, order, max_nodes)
        for context in (b"\n" * 4, b"the ", b"zzzz", b"\n\n\nt", b"e ca"):
            assert math.isclose(sum(slow.probability(context, b) for b in range(256)), 1)


def test_long_texts_in_runs(monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 50)
    texts = [b"abcab" * 30, b"", b"ab", b"abc abc"] * 3
    grams = np.concatenate([M.grams_of(run, 3)[0] for run in M._pieces(texts)])
    keys, sizes = M.grams_of(texts, 3)
    assert sorted(grams) == sorted(keys) and sizes.sum() == len(keys)


def test_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    table = M.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(np.setdiff1d(rng.integers(0, 1 << 48, 5000), keys)) == -1).all()
    assert (M.Table(keys[:0]).find(keys) == -1).all()


def test_empty(spark):
    assert M.score_documents(odd(spark, [])).count() == 0
    untrained = rows_of(M.score_documents(odd(spark, ROWS[:4]), M.F.lit(False)))
    same(untrained, model(ROWS[:4], M.ORDER, M.MAX_NODES, lambda i: False))


def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    held_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    found = QUERIES["op1_ppm_scoring"](spark, folder)
    assert all(r.held_out == held_out(r.doc_id) for r in found.collect())
    some = docs[:25]
    train = model(docs, 0, 1, lambda i: not held_out(i))
    got = rows_of(found.drop("held_out"))
    assert [x[:4] for x in got] == [x[:4] for x in train]
    assert np.allclose([x[4] for x in got], [x[4] for x in train])
    slow = Slow([b" ".join(words(t)) for i, t in docs if not held_out(i)], M.ORDER, M.MAX_NODES)
    scores = {x[0]: x[5] for x in got}
    assert all(math.isclose(scores[i], slow.score(b" ".join(words(t))), rel_tol=1e-9) for i, t in some)


def test_better_than_words_on_held_out_texts(spark):
    found = QUERIES["op1_ppm_scoring"](spark, "/root/testdata/sf0.1").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert found["sum(score)"] > found["sum(base_score)"]


def test_fold(spark):
    df = spark.createDataFrame([(1,), (None,), (77,)], "d long").select(fold_of(M.F.col("d"), 7).alias("f"))
    assert [r.f for r in df.collect()] == [zlib.crc32(b"1") % 7, -1, zlib.crc32(b"77") % 7]


def test_order_of_the_query():
    """Documents are scored with contexts of six bytes."""
    assert M.ORDER == 6 and M.score_documents.__defaults__[-3] == 6


def test_grams_the_trie_lacks_are_worked_out_once(monkeypatch):
    """A worker remembers their probabilities; with few places they push each other out, and scores stay the same."""
    texts = [b"a cat sat", b"", b"on the mat", b"zebras quack", b"a cat sat on the mat"]
    keys = np.concatenate([M.grams_of([t], 2)[0] for t in texts[:3]])
    nodes = lambda k, c: np.unique((keys >> 8 if c else keys) & ((1 << 8 * (k + 1 - c)) - 1), return_counts=True)
    trie = M.Trie.build(2, *({k: nodes(k, c) for k in range(3)} for c in (False, True)))
    scores = []
    for places in (1 << 12, 4):
        monkeypatch.setattr(M, "REMEMBERED", places)
        model = M.Model(trie)
        scores += [model.score(texts), model.score(texts)]
        if places > 4:
            monkeypatch.setattr(model, "_backed_off", lambda keys: pytest.fail("worked out again"))
            assert model.score(texts) == scores[0]
    for a in scores:
        assert a == scores[0]


def test_counted_grams_are_added_up_after_the_shuffle_only(spark):
    """Tasks have added up theirs; another table of them before the shuffle takes time and memory for nothing."""
    docs = spark.createDataFrame([("a cat sat",), ("a cat",), (None,)], "text string")
    plan = M.count_corpus(docs, "text", 2)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") or "Exchange" not in plan
    below = plan[plan.index("Exchange") :] if "Exchange" in plan else plan[plan.index("Repartition") :]
    assert "Aggregate" not in below
    counts = {bytes(r.word): r.n for r in M.count_corpus(docs, "text", 2).filter("word is not null").collect()}
    assert counts == {b"a": 2, b"cat": 2, b"sat": 1, b"\n": 3}


@pytest.mark.parametrize("order,held", [(3, 0), (6, 40), (4, 1 << 20)])
def test_rare_grams_are_not_forgotten(spark, monkeypatch, order, held):
    """By default every gram of the training texts is known, however few are held by the workers, and others escape step by step."""
    monkeypatch.setattr(M, "ASKED", held)
    rng = random.Random(2)
    rows = [r if r[0] != 6 else (6, r[1][:3000]) for r in ROWS]
    rows += [(100 + k, " ".join(rng.choice(("The", "cat", "sät", "on", "mat", "\x00", "x" * 70, f"w{k}")) for _ in range(30))) for k in range(12)]
    taught = lambda i: i is not None and i % 3 != 0
    found = M.score_documents(odd(spark, rows), M.F.col("_id") % 3 != 0, order=order, held=held)
    same(rows_of(found), model(rows, order, 1 << 40, taught))


def test_a_large_corpus_keeps_the_rare_grams(spark):
    """Contexts that stand once in millions of bytes are known like any other."""
    rows = [(1, "quartz"), (2, "quartz"), *((k, "ab " * 1_000_000) for k in (4, 5))]
    found = {r.doc_id: r.score for r in M.score_documents(odd(spark, rows), M.F.col("_id") != 2).collect()}
    # One of three texts begins like this, and goes on like this only.
    assert math.isclose(found[1], math.log10(0.5 / 3) + 6 * math.log10(0.5), rel_tol=1e-9) and found[2] == found[1]


def test_no_more_grams_than_asked_are_held(spark):
    likely = spark.createDataFrame([(k, 1 + k // 10, -1.0) for k in range(100)], "gram long, times long, log10 double")
    for held in (0, 5, 10, 33, 100):
        (_, grams, _), others = M._frequent(likely, 2, held)
        assert len(grams) <= held and len(grams) + others.count() == 100
        assert not len(grams) or min(grams) > max([-1, *(r.gram for r in others.collect())])
    assert len(grams) == 100


def test_other_texts_grams_are_counted_apart(spark):
    docs = spark.createDataFrame([("ab", True), ("ab", None), ("ac", False), ("ac", False)], "text string, t boolean")
    found = {r.gram: (r.n, r.others) for r in M.count_corpus(docs, "text", 1, M.F.col("t")).filter("gram is not null").collect()}
    pair = lambda x: x[0] << 8 | x[1]
    assert found == {pair(b"\na"): (1, 3), pair(b"ab"): (1, 1), pair(b"b\n"): (1, 1), pair(b"ac"): (0, 2), pair(b"c\n"): (0, 2)}
    assert {bytes(r.word): (r.n, r.others) for r in M.count_corpus(docs, "text", 1, M.F.col("t")).filter("word is not null").collect()} == {b"ab": (1, 0), b"\n": (1, 0)}
