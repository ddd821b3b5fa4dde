"""Quality by a regularised quadratic discriminant over transformed document statistics.

Labelled documents of either class, at most ``per_class`` of each (the ids with the smallest
hashes), give class means and covariances; a covariance is shrunk towards a multiple of the
identity, and its Cholesky factor is kept. A text's score is the logistic of the difference of
the two log densities (Mahalanobis distances through the factors) and of the log priors, which
are those of all labelled ids, as are the classes' shares in centre and scale, so scores do not drift with
the size of the table. Fitting reads a bounded number of documents, and counts all labels in
one aggregate; scoring is one pass without a shuffle.

Nulls: a null text counts as empty; a null id is never labelled. Ids with conflicting labels
take the lower one. Repeated rows are scored each. Without labels of both classes every score
is 1: nothing is known against a text. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, at, identified, let_go, sealed

FEATURES = (
    "words", "word_length", "symbols", "capitals", "digits", "marks", "bars",
    "distinct", "same_neighbour", "repeated_lines", "stops", "line_words",
)


def _byte_classes() -> np.ndarray:
    classes = np.zeros((256, 9))
    for k, members in enumerate((b"#*$%&<>@^~=+\\{}[]_", bytes(range(65, 91)), b"0123456789", b"!?;:\"()", b"|", b".,", SPACES, b"\n")):
        classes[list(members), k] = 1
    classes[:, 8] = [not 0x80 <= c < 0xC0 for c in range(256)]  # every code point has one such byte
    return classes


CLASSES = _byte_classes()
# Texts judged at a time: each takes 2 KB of byte counts.
ROWS = 1024


def features(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has zeros."""
    counts = np.empty((len(texts), 256))
    rest = np.zeros((len(texts), 5))
    for k, text in enumerate(texts):
        counts[k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lines = [x for x in (line.strip() for line in text.split(b"\n")) if x]
        rest[k] = len(words), len(set(words)), sum(map(eq, words, words[1:])), len(lines), len(set(lines))
    symbols, capitals, digits, marks, bars, stops, spaces, _, points = (counts @ CLASSES).T
    n, distinct, same, lines, distinct_lines = rest.T
    # Some usual text is added to every text, so a short one's shares stay close to usual ones.
    chars, more = np.maximum(points - spaces, 0) + 100, n + 20
    share = lambda x, usual=0.0: np.sqrt((x + usual) / chars)
    return np.column_stack([
        np.log(more), np.log(chars / more), share(symbols), share(capitals, 2), share(digits), share(marks), share(bars),
        np.log(distinct + 20) / np.log(more), np.sqrt(same / more), np.sqrt((lines - distinct_lines) / (lines + 5)),
        share(stops, 3), np.log((n + 40) / (lines + 3)),
    ])


@dataclass(frozen=True)
class Quadratic:
    """Class means, inverse Cholesky factors and log determinants over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    logdets: tuple[float, float]
    log_prior: float
    reach: float = 8.0

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, shrinkage: float = 0.1, counts: tuple[int, int] | None = None) -> Quadratic | None:
        """``counts`` are of all bad and all good, which the given rows are a sample of; by default they are all."""
        if good.all() or not good.any():
            return None
        all_bad, all_good = counts or ((~good).sum(), good.sum())
        weight = np.where(good, all_good / good.sum(), all_bad / (~good).sum())
        centre = np.average(x, 0, weight)
        scale = np.sqrt(np.average((x - centre) ** 2, 0, weight))
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.clip((x - centre) / scale, -cls.reach, cls.reach)
        means, whiten, logdets = [], [], []
        for of in (z[~good], z[good]):
            mean = of.mean(0)
            spread = (of - mean).T @ (of - mean) / max(len(of) - 1, 1)
            level = max(float(np.trace(spread)) / spread.shape[0], 1e-3)
            factor = np.linalg.cholesky((1 - shrinkage) * spread + shrinkage * level * np.eye(spread.shape[0]))
            means.append(mean)
            whiten.append(np.linalg.inv(factor))
            logdets.append(2 * float(np.log(np.diag(factor)).sum()))
        prior = float(np.log(all_good / all_bad))
        return cls(centre, scale, tuple(means), tuple(whiten), tuple(logdets), prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -self.reach, self.reach)
        bad, good = (-0.5 * ((((z - m) @ w.T) ** 2).sum(1) + d) for m, w, d in zip(self.means, self.whiten, self.logdets))
        return 1 / (1 + np.exp(-np.clip(good - bad + self.log_prior, -700, 700)))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    per_class: int = 8192, shrinkage: float = 0.1,
) -> Quadratic | None:
    """The discriminant of labelled texts, of at most ``per_class`` labelled ids of each class; the prior counts all ids."""
    known = sealed(labels).select(at(labels, id_column).alias("_id"), at(labels, label_column).cast("int").alias("_label"))
    known = known.dropna().groupBy("_id").agg(F.min("_label").alias("_label"))
    counts = known.agg(F.count_if(F.col("_label") == 0), F.count_if(F.col("_label") == 1)).first()
    chosen = [known.filter(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (0, 1)]
    texts = identified(docs, id_column, text_column).join(F.broadcast(chosen[0].unionAll(chosen[1])), "_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.record_batch([batch.column(0), *[pa.array(c) for c in x.T]], names=["_label", *FEATURES])

    found = texts.select("_label", "_text").mapInArrow(rows, "_label int, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    found = found.sort_values(list(found.columns))  # sums in one order, whatever order the tasks end in
    return Quadratic.fit(found[list(FEATURES)].to_numpy(), found["_label"].to_numpy() == 1, shrinkage, tuple(counts)) if len(found) else None


def score_quality(docs: DataFrame, model: Quadratic | None, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All columns of the documents and the score, 0 to 1."""
    names = [c for c in docs.columns if c != score_column]
    plain = sealed(docs).select(*[at(docs, c) for c in names])
    if model is None:
        return plain.withColumn("s", F.lit(1.0)).toDF(*names, score_column)
    text = names.index(text_column)
    schema = plain.withColumn("s", F.lit(None).cast("double")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([*batch.columns, pa.array(model.score(features(texts)))], names=schema.names)

    return plain.mapInArrow(rows, schema).toDF(*names, score_column)
