import re

import duckdb
import pytest
from cases import odd, rows_of
from test_decontaminate import words

from edaspark.llm import license_scan as S
from edaspark.llm.queries import NOTICES_SQL, QUERIES

GRANT = dict(S.NOTICES)["MIT-grant"]
FILL = " ".join(f"w{k}" for k in range(333))
ROWS = [
    (1, GRANT),
    (2, f"{FILL}\n{GRANT.upper()}! {FILL}"),
    (2, f"{FILL}\n{GRANT.upper()}! {FILL}"),
    (3, GRANT.replace("hereby", "thereby")),  # four shingles of eleven differ
    (4, GRANT.replace("software", "program")),  # one differs
    (5, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
    (6, "Permission is hereby granted"),
    (7, None),
    (8, ""),
    (None, "x Released under the MIT License"),
    (9, " ".join([GRANT, FILL] * 30)),
]


def model(rows, notices, containment=0.8):
    out = []
    for i, t in rows:
        w = words(t)
        doc = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for name, text in notices:
            x = words(text)
            of = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
            m = len(x) - 4
            step = max(1, m // 2)
            found = []
            for a in range(0, len(doc), step):
                share = len(of & set(doc[a : a + m + step])) / len(of) if of else 0
                if share >= containment:
                    found.append((-share, a))
            if found:
                out.append((i, name, -min(found)[0], min(found)[1], len(found)))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    notices = spark.createDataFrame([*S.NOTICES, ("short", "MIT License"), ("none", None), ("empty", "")], "license string, text string")
    found = rows_of(S.find_notices(odd(spark, ROWS), notices))
    assert found == model(ROWS, S.NOTICES)
    assert {(r[0], r[1]) for r in found} >= {(1, "MIT-grant"), (2, "MIT-grant"), (4, "MIT-grant"), (5, "MIT"), (5, "CC-BY-NC-4.0"), (None, "MIT")}
    assert not any(r[0] in (3, 6) for r in found)


def test_empty(spark):
    notices = spark.createDataFrame(S.NOTICES, "license string, text string")
    assert S.find_notices(odd(spark, []), notices).count() == 0
    assert S.find_notices(odd(spark, ROWS), notices.limit(0)).count() == 0


def test_too_many(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_TEMPLATES", 3)
    with pytest.raises(ValueError):
        S.find_notices(odd(spark), spark.createDataFrame(S.NOTICES, "license string, text string"))


def test_query(spark, folder):
    df = QUERIES["op4_license_scan"](spark, folder)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    got = rows_of(df)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got == model(docs, S.NOTICES) and got
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    names = [d[0] for d in db.execute(NOTICES_SQL).description]
    assert names == df.columns
    assert got == sorted(db.fetchall(), key=repr)


def test_two_texts_of_a_license(spark):
    """Texts of one license with as many words are two templates: a document that holds one whole is found."""
    texts = [" ".join(f"{c}{k}" for k in range(16)) for c in "ab"]
    notices = spark.createDataFrame([("X", t) for t in texts], "license string, text string")
    found = S.find_notices(odd(spark, [(1, texts[0]), (2, texts[1])]), notices)
    assert sorted((r.doc_id, r.license, r.containment) for r in found.collect()) == [(1, "X", 1.0), (2, "X", 1.0)]
