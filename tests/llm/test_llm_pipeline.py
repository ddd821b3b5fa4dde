"""The pipeline against plain Python models of its stages."""

import numpy as np
import corpus_pipeline
from cases import odd
from test_decontaminate import model as spans_model
from test_line_runs import model as lines_model

from edaspark.llm import piece_dropout as P
from edaspark.llm.queries import QUERIES


def near_model(rows):
    """One row, of the smallest id, of each component of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            if (both >= 0.8 * (len(a) + len(b) - both) and both) or not (a or b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [row for k, row in enumerate(rows) if find(k) == k]


def test_stages_against_models(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    scores = {r.doc_id: r.score for r in QUERIES["op10_quadratic_quality"](spark, folder).collect()}
    all_rows = {r.doc_id: r for r in docs.collect()}
    rows = sorted((i, all_rows[i].text) for i, s in scores.items() if s >= 0.7)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == rows
    assert 0 < len(rows) < len(all_rows)

    rows = [(i, t) for i, t, _, _ in lines_model(rows)]
    rows = near_model(sorted(rows))
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {i for i, _, n, _ in spans_model(rows, items) if n}
    rows = [(i, t) for i, t in rows if i not in hit]

    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [*docs.columns, "ids"]
    got = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.ids) for r in found.collect())
    pieces = P.Pieces(P.read_vocabulary())
    want = []
    for i, t in rows:
        ids = np.frombuffer(pieces.encode(t, i, 13, 0.1), "<i4").tolist()
        want.append((i, t, all_rows[i].lang, all_rows[i].source, len(t), ids))
    assert got == want


def test_odd_rows_through_all_stages(spark, folder):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert {"doc_id", "text", "a.b"} <= set(docs.columns)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() >= 1
    empty = odd(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0
