import random

import numpy as np
from cases import odd

from edaspark.llm import near_copies as N
from edaspark.llm import simhash_anchors as S


def similarity(a, b):
    cut = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


def test_sets_and_bands():
    words = [b"w%d" % k for k in range(300)]
    near = [*words[:150], b"other", *words[151:]]
    a, b = N.shingles(words), N.shingles(near)
    assert len(a) == 296 and N.similarity_of(a, b) == 291 / 301
    assert (N.bands(a) == N.bands(b)).sum() > 10
    assert not (N.bands(a) == N.bands(N.shingles([b"x" + w for w in words]))).any()
    assert len(N.shingles([b"a", b"b"])) == 1 and not len(N.shingles([]))


def test_near_copies_on_documents(spark):
    """No two kept documents are near copies, and each dropped one has a near copy of a smaller id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = dict(docs.collect())
    kept = {r.doc_id for r in S.keep_one_of_each(docs).collect()}
    links = [(i, j) for i in text for j in text if i < j and min(len(text[i]), len(text[j])) > 0.5 * max(len(text[i]), len(text[j]))]
    sets = {i: N.shingles(t.lower().encode().split()) for i, t in text.items()}
    links = {(i, j) for i, j in links if N.similarity_of(sets[i], sets[j]) >= 0.8}
    assert sum(text[i] != text[j] for i, j in links) >= 12
    assert not any(i in kept and j in kept for i, j in links)
    assert set(text) - kept == {j for _, j in links}


def test_families_with_common_bands(spark, monkeypatch):
    """Texts that share most words with all others, near copies of some: all are found, in parts and rounds."""
    monkeypatch.setattr(N, "MEMBERS", 3)
    monkeypatch.setattr(N, "HOT", 6)
    rng = random.Random(3)
    common = [f"c{k}" for k in range(170)]
    rows = []
    for family in range(20):
        own = common + [f"f{family}x{k}" for k in range(90)]
        rows += [(len(rows) + k, " ".join([*own, *(f"m{family}y{k}z{j}" for j in range(10))])) for k in range(4)]
    rng.shuffle(rows)
    assert similarity(dict(rows)[0], dict(rows)[1]) >= 0.8 > similarity(dict(rows)[0], dict(rows)[4])
    kept = S.keep_one_of_each(odd(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 4))


def test_below_the_limit_nothing_goes(spark):
    """Five of 26 shingles less: similarity 21/31; the fingerprints may be near."""
    words = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:15], "new", *words[16:]])), (3, "one"), (4, "ONE\n"), (5, "one two")]
    assert similarity(rows[0][1], rows[1][1]) < 0.8
    assert sorted(r.doc_id for r in S.keep_one_of_each(odd(spark, rows)).collect()) == [1, 2, 3, 5]
    assert np.isclose(N.similarity_of(*(N.shingles(t.encode().split()) for _, t in rows[:2])), similarity(rows[0][1], rows[1][1]))


def test_chains_are_one_component(spark):
    """Neighbours of a chain are near copies, its ends are not: one row stays of each chain, of the smallest id."""
    rows = []
    for chain in range(40):
        words = [f"c{chain}w{k}" for k in range(120)]
        for step in range(8):
            rows.append((len(rows), " ".join([*(f"c{chain}s{k}" for k in range(step * 8)), *words[step * 8 :]])))
    text = dict(rows)
    assert all(similarity(text[k], text[k + 1]) >= 0.8 > similarity(text[k], text[(k + 2) % 8]) for k in range(6))
    random.Random(5).shuffle(rows)
    assert sorted(r.doc_id for r in S.keep_one_of_each(odd(spark, rows)).collect()) == list(range(0, 320, 8))


def test_pairs_grow_with_the_members(spark, monkeypatch):
    """Texts that share 60 % of their shingles with all others: pairs at most double with them, none is dropped."""
    seen = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    counts = []
    for n in (100, 200, 400):
        common = [f"c{k}" for k in range(200)]
        rows = [(i, " ".join([*common, *(f"t{i}x{k}" for k in range(60))])) for i in range(n)]
        assert 0.55 < similarity(rows[0][1], rows[1][1]) < 0.65
        seen.clear()
        assert S.keep_one_of_each(odd(spark, rows)).count() == n
        counts.append(sum(seen))
    assert counts[0] and counts[2] <= 2.2 * counts[1] <= 2.2 * 2.2 * counts[0] and counts[2] < 24 * 400


def test_families_and_strays(spark, monkeypatch):
    """A family in parts and rows of random similarity to it: components as those of all pairs."""
    monkeypatch.setattr(N, "HOT", 16)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(200), rng.choice([0, 1, 2, 3, 8, 12])):
            words[k] = f"n{i}x{k}"
        rows.append((i, " ".join(words)))
    sets = {i: N.shingles(t.encode().split()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in sets:
        for i in range(j):
            if N.similarity_of(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = [i for i in sets if find(i) == i]
    assert 5 < len(want) < 120
    assert sorted(r.doc_id for r in S.keep_one_of_each(odd(spark, rows)).collect()) == want


def test_families_of_near_fingerprints_come_first(spark, monkeypatch):
    """Near texts are paired through the anchors of their fingerprints; a pair below the similarity stays two."""
    asked = []
    families = S.near_families
    monkeypatch.setattr(S, "near_families", lambda nodes: asked.append(1) or families(nodes))
    words = [f"w{k}" for k in range(2000)]
    near = [*words[:700], "new", *words[701:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"x{k}" for k in range(2000))), (4, "a b c d e f g"), (5, None)]
    nodes = N._nodes(odd(spark, rows), "doc_id", "text", 5)
    found = S.near_families(nodes).collect()
    assert len(found) == 1 and {r.node for r in nodes.collect()} > {found[0].a, found[0].b}
    asked.clear()
    assert sorted(r.doc_id for r in S.keep_one_of_each(odd(spark, rows)).collect()) == [1, 3, 4, 5] and asked
