import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from cases import ROWS, odd, rows_of

from edaspark.llm import line_runs as L
from edaspark.llm.queries import LINES_SQL, QUERIES

SPACES = " \t\n\x0b\x0c\r"


def model(rows, chars=40, docs=5):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(SPACES))
    low = lambda i: -(1 << 63) if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or len(holders[key(x)]) < docs or max(holders[key(x)]) == low(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    return rows_of(df.select("doc_id", "text", "n_lines", "n_dropped"))


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2), (7, 3)])
def test_against_model(spark, batches, fanout):
    rng = random.Random(3)
    pool = [f"Line {k} é" + "x" * rng.choice((20, 31, 32, 33, 50)) for k in range(12)]
    rows = list(ROWS)
    for i in range(60):
        lines = [rng.choice(SPACES.replace("\n", "") + "  ") + rng.choice((str.upper, str))(rng.choice(pool)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice((100 + i, 100 + i // 2, None)), "\n".join(lines)))
    got = L.drop_repeated_lines(odd(spark, rows), batches=batches, fanout=fanout)
    assert set(odd(spark).columns) - {"n_lines"} < set(got.columns)
    assert found(got) == model(rows)


def test_empty(spark):
    assert L.drop_repeated_lines(odd(spark, [])).count() == 0


def test_runs_hold_a_key_once(spark):
    runs = L.LineRuns(spark, fanout=2)
    for b in range(5):
        rows = [(k, k * 7, 100 - b, 1) for k in range(b, b + 4)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, holder long, n long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    held = runs.runs().filter("holder is not null")
    assert held.count() == held.select("h1", "h2").distinct().count() == 8
    assert {(r.h1, r.holder, r.n) for r in runs.merged(runs.runs()).collect()} == {
        (k, 100 - max(0, k - 3), min(k, 4) - max(0, k - 3) + 1) for k in range(8)
    }


def test_query(spark, folder):
    got = rows_of(QUERIES["op5_line_dedup"](spark, folder))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert got == sorted(db.execute(LINES_SQL).fetchall(), key=repr)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got == [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in model(docs)]
