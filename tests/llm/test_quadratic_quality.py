import zlib

import numpy as np
from cases import odd

from edaspark.llm import quadratic_quality as Q
from edaspark.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op10_quadratic_quality"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert ((found.score >= 0) & (found.score <= 1)).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    both = found[found.held_out].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert (good.predicted == 1).mean() > 0.97
    assert (bad.predicted == 0).mean() > 0.9


def test_only_training_labels_matter(spark, folder):
    """Turning the held-out labels around changes no score."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    from edaspark.llm.common import fold_of

    turned = labels.withColumn("quality", Q.F.when(fold_of(Q.F.col("doc_id"), 4) == 2, 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = (Q.fit_quality(docs, x.filter(fold_of(Q.F.col("doc_id"), 4) != 2)) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip((a.centre, *a.means, *a.whiten), (b.centre, *b.means, *b.whiten)))


def test_density_difference():
    """Against the textbook formula, with full covariances."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (600, 3))])
    good = np.arange(1000) >= 400
    m = Q.Quadratic.fit(x, good, 0.2)
    z = (x - x.mean(0)) / x.std(0)

    def log_density(v, of):
        mean, spread = of.mean(0), np.cov(of.T)
        spread = 0.8 * spread + 0.2 * np.trace(spread) / 3 * np.eye(3)
        d = v - mean
        return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(spread), d) + np.linalg.slogdet(spread)[1])

    want = 1 / (1 + np.exp(-(log_density(z, z[good]) - log_density(z, z[~good]) + np.log(0.6 / 0.4))))
    assert np.allclose(m.score(x), want)


def test_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (8, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    found = Q.score_quality(docs, Q.fit_quality(docs, labels))
    assert sorted(found.columns) == sorted(docs.columns)
    assert found.count() == docs.count()
    assert found.filter("score is null or isnan(score) or score < 0 or score > 1").count() == 0


def test_without_labels(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_quality(docs, Q.fit_quality(docs, none)).collect()} == {1.0}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert Q.fit_quality(docs, one) is None
    assert Q.score_quality(odd(spark, []), Q.fit_quality(odd(spark, []), one)).count() == 0


def test_prior_of_all_labels(spark):
    """A sample with as many of either class has the prior of all labels, and nearly the scores of the whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    whole, sample = Q.fit_quality(docs, labels), Q.fit_quality(docs, labels, per_class=min(n.values()))
    assert sample.log_prior == whole.log_prior == float(np.log(n[1] / n[0]))
    assert np.abs(sample.centre - whole.centre).max() < 0.1 * whole.scale.max()
