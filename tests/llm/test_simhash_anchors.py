import random

import numpy as np
import pytest
import xxhash
from cases import ROWS, odd, rows_of

from edaspark.llm import common
from edaspark.llm import simhash_anchors as S
from edaspark.llm.queries import QUERIES


def slow_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{row index: members} by comparing everything."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def check(found, rows):
    prints = [slow_print(t) for _, t in rows]
    group = slow_components(prints)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    want = sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group)), key=repr)
    assert found == want


def test_odd_rows(spark):
    check(rows_of(S.near_duplicates(odd(spark))), ROWS)


def test_empty(spark):
    assert S.near_duplicates(odd(spark, [])).count() == 0
    assert S.keep_one_of_each(odd(spark, [])).count() == 0


def test_keep_one(spark):
    kept = S.keep_one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == [1, 3, 6, 7, 8, 9, None]  # 2 copies 1; 4, 5 and a null text are blank like 3


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(rows_of(QUERIES["op3_simhash_near_dedup"](spark, folder)), [tuple(r) for r in docs])


def test_anchors_meet():
    rng = random.Random(5)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        kx, _, hx = S.anchors_of(np.array([x], np.uint64))
        ky, _, hy = S.anchors_of(np.array([y], np.uint64))
        assert set(kx[hx]) & set(ky)
        assert set(ky[hy]) & set(kx)


@pytest.mark.parametrize("homes,held,pairs", [(4096, 1 << 20, 1 << 22), (5, 40, 64)])
def test_links_join_all_near(spark, monkeypatch, homes, held, pairs):
    """Dense groups, chains and strangers; with full anchors split and groups streamed too."""
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
    x = rng.getrandbits(64)
    prints |= {x ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    prints = sorted(prints)
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "PAIRS", pairs)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    root = {r.node: r.root for r in S.components(S.near_links(df, homes)).collect()}
    mine = [root.get(p - (1 << 64) if p >> 63 else p, p - (1 << 64) if p >> 63 else p) for p in prints]
    want = slow_components(prints)
    pairs = {(a, b) for a, b in zip(mine, want)}
    assert len(pairs) == len(set(mine)) == len(set(want))


def test_parts_of_neighbouring_anchors():
    """Part 31 of an anchor and part 0 of the next are two groups."""
    a, b = 0x0F0F, 0x7FFF0000FFFF
    rows = {"key": [7, 7, 8, 8], "part": [31, 31, 0, 0], "fp": [a, ~a, b, b ^ 1], "home": [True, False, True, False]}
    found = [x for batch in S._compare(iter([S.pa.record_batch(rows)])) for x in zip(*(c.to_pylist() for c in batch.columns))]
    assert found == [(b, b ^ 1)]


def test_memory_of_a_full_anchor():
    """The pairs of one full anchor are compared in blocks of a few MB, not 32 MB an array."""
    import tracemalloc

    n, rng = 3000, np.random.default_rng(5)
    home = np.arange(n) < 1500
    fp = rng.integers(0, 1 << 60, n)
    fp[-1] = fp[0] ^ 1
    tracemalloc.start()
    a, b = S._links(np.zeros(n, np.int64), np.zeros(n, np.int32), fp, home)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((a[0], b[0])) == sorted((fp[0], fp[-1])) and len(a) == 1
    assert peak < 48 << 20


def test_a_worker_keeps_the_tables_of_one_operator():
    made = []
    assert common.kept("x", lambda: made.append("x") or "tables") == common.kept("x", list) == "tables"
    assert common.kept("y", lambda: made.append("y") or "others") == "others"
    assert list(common._KEPT) == ["y"] and made == ["x", "y"]
    common.let_go()
    assert not common._KEPT
