import random
import time

import pytest
from conftest import rows

from edaspark.operators import ranks


def jobs_of(spark, group, act):
    spark.sparkContext.setJobGroup(group, group)
    out = act()
    time.sleep(0.2)
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("none", "none")
    return n, out


def table(spark, columns, n, seed, gaps=0.2, values=9):
    rng = random.Random(seed)
    cell = lambda: None if rng.random() < gaps else rng.choice([rng.randrange(values), rng.random()])
    return spark.createDataFrame([tuple(None if (v := cell()) is None else float(v) for _ in range(columns)) for _ in range(n)], ", ".join(f"c{k} double" for k in range(columns)))


def slow_rank(values):
    order = sorted(values)
    return [(2 * order.index(v) + order.count(v) + 1) / 2 for v in values]


def slow_spearman(data, i, j):
    both = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
    if len({a for a, _ in both}) < 2 or len({b for _, b in both}) < 2:
        return None
    a, b = slow_rank([x for x, _ in both]), slow_rank([x for _, x in both])
    m = (len(both) + 1) / 2
    dot = lambda x, y: sum((p - m) * (q - m) for p, q in zip(x, y))
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


@pytest.mark.parametrize("slice_rows", [30, 1_000_000])
def test_gappy_pairs_against_model(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(ranks, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(ranks.ranks_by_slot, "__defaults__", (slice_rows,))
    df = table(spark, 4, 60, 1)
    data = rows(df)
    got = {(x, y): r for x, y, r in rows(ranks.spearman(df))}
    for i in range(4):
        for j in range(4):
            assert got[f"c{i}", f"c{j}"] == pytest.approx(slow_spearman(data, i, j), abs=1e-12)


@pytest.mark.parametrize("numbers, share", [(0, 10), (60, 2), (150, 1000)])
def test_gappy_columns_too_large_to_broadcast(spark, monkeypatch, numbers, share):
    monkeypatch.setattr(ranks, "SLICE_ROWS", 40)
    monkeypatch.setattr(ranks, "RANK_NUMBERS", numbers)
    monkeypatch.setattr(ranks, "HOT_SHARE", share)
    rng = random.Random(share)
    cells = [(lambda: float(rng.randrange(3))), (lambda: rng.random()), (lambda: rng.choice([0.0, rng.random()])), (lambda: float(rng.randrange(40))), (lambda: rng.choice([float("inf"), -1.5]))]
    gaps = [0.3, 0.1, 0.2, 0.0, 0.5]
    data = [tuple(None if rng.random() < g else c() for c, g in zip(cells, gaps)) for _ in range(150)]
    df = spark.createDataFrame(data, ", ".join(f"c{k} double" for k in range(5))).repartition(3)
    got = {(x, y): r for x, y, r in rows(ranks.spearman(df))}
    for i in range(5):
        for j in range(5):
            assert got[f"c{i}", f"c{j}"] == pytest.approx(slow_spearman(data, i, j), abs=1e-12), (i, j)


def test_pairs_with_gaps_do_not_shuffle_rows_per_pair(spark, monkeypatch):
    monkeypatch.setattr(ranks, "_pair_cells", None)  # cells of all pairs took a row's place once for each pair
    df = table(spark, 6, 80, 5)
    data = rows(df)
    got = {(x, y): r for x, y, r in rows(ranks.spearman(df))}
    assert got["c1", "c4"] == pytest.approx(slow_spearman(data, 1, 4), abs=1e-12)


def test_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, None, 3.0), (2.0, None, 4.0, 3.0), (None, None, 5.0, 3.0)], "a double, nothing double, b double, same double")
    got = {(x, y): r for x, y, r in rows(ranks.spearman(df))}
    assert got["a", "a"] == pytest.approx(1) and got["a", "b"] is None and got["nothing", "a"] is None and got["same", "a"] is None and got["same", "same"] is None
    assert all(r is None for _, _, r in rows(ranks.spearman(df.limit(0))))


def test_jobs_do_not_depend_on_pairs(spark):
    few, _ = jobs_of(spark, "few", lambda: ranks.spearman(table(spark, 3, 50, 2)).collect())
    many, _ = jobs_of(spark, "many", lambda: ranks.spearman(table(spark, 12, 50, 2)).collect())
    assert many <= few + 2
    few, _ = jobs_of(spark, "few2", lambda: ranks.spearman(table(spark, 3, 50, 2, gaps=0)).collect())
    many, _ = jobs_of(spark, "many2", lambda: ranks.spearman(table(spark, 12, 50, 2, gaps=0)).collect())
    assert many <= few + 12  # the broadcasts, one for each column


def slow_cramers(pairs):
    pairs = [p for p in pairs if None not in p]
    n = len(pairs)
    a, b = {x for x, _ in pairs}, {y for _, y in pairs}
    least = min(len(a), len(b)) - 1
    if least < 1:
        return None
    count = lambda k, v: sum(p[k] == v for p in pairs)
    chi = sum(pairs.count((x, y)) ** 2 / (count(0, x) * count(1, y)) for x in a for y in b) - 1
    return max(0.0, chi / least) ** 0.5 if n else None


def test_cramers_against_model(spark):
    rng = random.Random(3)
    long = "x" * 100
    data = [(k, rng.choice("ab"), rng.choice(["p", "q", long, long + "y", None]), rng.choice([1, 2, 3]), "same") for k in range(80)]
    df = spark.createDataFrame(data, "key long, a string, b string, c long, d string")
    got = {(x, y): v for x, y, v in rows(ranks.cramers_v(df, df.columns))}
    for i in range(5):
        for j in range(i):
            assert got[df.columns[i], df.columns[j]] == pytest.approx(slow_cramers([(r[i], r[j]) for r in data]), abs=1e-12), (i, j)
    few, _ = jobs_of(spark, "three", lambda: ranks.cramers_v(df, ["a", "b", "c"]).collect())
    many, _ = jobs_of(spark, "all", lambda: ranks.cramers_v(df, df.columns).collect())
    assert many <= few + 2


def test_few_columns_without_gaps_are_not_joined_to_their_ranks(spark, monkeypatch):
    """counting values, ranking and joining them shuffled every value three times; rows are sorted once instead."""
    rng = random.Random(3)
    rows = [(k * 7919 % 900, rng.choice([0.0, -0.0, 1.5, float("inf")]), rng.randrange(400), 5) for k in range(900)]
    df = spark.createDataFrame(rows, "a long, b double, c int, d int").repartition(3)
    monkeypatch.setattr(ranks, "RANK_NUMBERS", 100)
    monkeypatch.setattr(ranks, "SORTED", -1)
    joined = {(r.x, r.y): r.r for r in ranks.spearman(df).collect()}
    monkeypatch.setattr(ranks, "SORTED", 8)
    monkeypatch.setattr(ranks, "_rank_correlations", lambda *_: pytest.fail("joined"))
    found = {(r.x, r.y): r.r for r in ranks.spearman(df).collect()}
    assert found.keys() == joined.keys() and len(found) == 16
    for pair, r in joined.items():
        assert found[pair] == (None if "d" in pair else pytest.approx(r, abs=1e-12))
