import re

import duckdb
from cases import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from edaspark.llm import url_automaton as U
from edaspark.llm.queries import QUERIES, RULES, URLS_SQL

ROWS = [
    (1, None), (2, ""), (3, "no scheme.org/en/"), (4, "https://EXAMPLE.org/en/12?x#y"), (5, "http://a.example.org/es/"), (6, "http://badexample.org/es/"),
    (7, "http://org"), (8, "http://org/"), (9, "http://x.com/fr/1"), (10, "http://com/de/1"), (11, "http://x.com/path/y.org/"), (12, "http://www.cheap-pills.net"),
    (13, "http://www.cheap-pills.net/a/b"), (14, "http://x.net/cheap-"), (15, "a://b://c.org/"), (16, "http://x.org?q=://y.com/de/"), (17, "http://Ünï.org/é"),
    (18, "http://x.com:80/de/"), (19, "://"), (20, "http:///fr/"), (20, "http:///fr/"), (None, "http://example.org/en/1"), (21, "http://" + "a" * 5000 + ".org/" + "b" * 20000),
    (22, "http://x.org\n/fr/"),
]


def to_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
        i += 1
    return re.compile(out, re.S)


GLOB = st.text(st.sampled_from("ab/*?"), max_size=7)


@given(st.lists(GLOB, min_size=1, max_size=30), st.lists(st.text(st.sampled_from("ab/"), max_size=9), max_size=8))
@settings(max_examples=300, deadline=None)
def test_automaton_as_regular_expressions(globs, texts):
    found = U.Automaton(globs).matches([t.encode() for t in texts])
    assert found.tolist() == [[bool(to_regex(g).fullmatch(t)) for g in globs] for t in texts]


def pages(spark, rows):
    data = [(*r, "x", "y", "z") for r in rows]
    return spark.createDataFrame(data, "page_id long, url string, host string, path string, rule string").repartition(3)


def test_odd_rows(spark):
    got = rows_of(U.judge_urls(pages(spark, ROWS), RULES))
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar)")
    db.executemany("insert into pages values (?, ?)", [r for r in ROWS if r[0] not in (20, None)])
    assert [r for r in got if r[0] not in (20, None)] == sorted(db.execute(URLS_SQL).fetchall(), key=repr)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[6][2:] == ("org/", "allow") and by[7][2:] == (None, "allow") and by[8][2:] == ("org/", "allow")
    assert by[11][2] is None and by[12][3] == by[13][3] == "block" and by[14][3] == "allow"
    assert by[None][2] == "example.org/en/1" and sum(r[0] == 20 for r in got) == 2
    assert by[21][2] == "org/"


def test_empty(spark):
    assert U.judge_urls(pages(spark, []), RULES).count() == 0
    assert {r.verdict for r in U.judge_urls(pages(spark, ROWS), [], []).collect()} == {"allow"}


def test_query(spark, folder):
    df = QUERIES["op8_url_automaton"](spark, folder)
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    assert [d[0] for d in db.execute(URLS_SQL).description] == df.columns
    assert rows_of(df) == sorted(db.fetchall(), key=repr)
