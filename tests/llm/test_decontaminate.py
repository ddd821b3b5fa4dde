import hashlib
import re

import duckdb
import pytest
from cases import LONG, ROWS, odd, rows_of

from edaspark.llm import decontaminate as D
from edaspark.llm.queries import QUERIES, SPANS_SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "Fox jumps, over THE lazy dog: and then rests a while under"),
    (2, "one TWO"),
    (2, "one TWO"),
    (3, None),
    (4, "..."),
    (None, "quick brown"),
    (5, " ".join(LONG.split()[500:540])),
    (6, "Straße"),
    (7, "word1 of1 word2"),
]


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def model(rows, items, width=10):
    out = []
    for i, t in rows:
        w, hit, of = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(width, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    of |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), ",".join(sorted(of))))
    return sorted(out, key=repr)


def found(df):
    return rows_of(df.select("doc_id", "n_words", D.hit_words().alias("n"), D.F.array_join("items", ",")))


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_odd_rows(spark, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(D.contaminated_spans(odd(spark), items, broadcast_windows=limit)) == model(ROWS, ITEMS)
    kept = D.drop_contaminated(odd(spark), items, broadcast_windows=limit)
    assert kept.columns == odd(spark).columns
    clean = [i for i, _, n, _ in model(ROWS, ITEMS) if not n]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == clean


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contaminated_spans(odd(spark, []), items).count() == 0
    assert found(D.contaminated_spans(odd(spark), items.limit(0))) == model(ROWS, [])
    assert D.drop_contaminated(odd(spark), items.limit(0)).count() == len(ROWS)


def test_native(spark, folder):
    plan = QUERIES["op9_decontamination"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_query(spark, folder):
    got = rows_of(QUERIES["op9_decontamination"](spark, folder))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert got == sorted(db.execute(SPANS_SQL).fetchall(), key=repr)
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    slow = [(i, n, h, len(x.split(",")) if x else 0, hashlib.sha256(x.encode()).hexdigest(), h > 0) for i, n, h, x in model(docs, items)]
    assert got == slow
    assert any(r[-1] for r in got)
