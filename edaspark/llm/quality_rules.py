"""Quality rules and a hashed n-gram log-likelihood ratio between trusted and raw text.

Word unigrams and bigrams fall into hashed buckets. Their counts over all documents make the raw
multinomial, those over trusted documents the target; raw counts are scaled to the target's total and
both are smoothed by ``alpha`` per bucket, so a bucket too rare to be expected in the target says little. A
document's ratio is the mean over its n-grams of log(target / raw), and it is kept when it passes the plain
rules and its ratio is at least ``threshold``: every document, by the same fixed number.

Trusted documents are all that the labels trust, and raw counts cover every document. Up to BROADCAST trusted ids are
broadcast; more of them meet the texts in a shuffled join. Without trusted documents the plain rules decide alone.

A null or blank text has no words and fails. Repeated rows are judged each. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise_table
from .common import SPACES, at, identified, sealed

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
# Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIX = np.uint64(0x9E3779B97F4A7C15)
# Trusted ids that may be broadcast.
BROADCAST = 1_000_000


def numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in order of appearance, and a hash of each distinct word."""
    of: dict[bytes, int] = {}
    ids = np.array([of.setdefault(w, len(of)) for w in words], np.int64)
    return ids, np.fromiter(map(crc32, of), np.uint64, len(of))


def buckets(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Buckets of all unigrams, then of all bigrams."""
    h = (hashes[ids] + np.uint64(1)) * MIX
    pairs = ((h[:-1] >> np.uint64(29)) ^ h[1:]) * MIX
    return (np.concatenate((h, pairs)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def repeat_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that the text has at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    if len(ids) >= 1 << 20:  # so that the product below fits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    often = np.zeros(len(windows), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= often
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    solid = text.translate(None, SPACES)
    continued = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0))))
    lines = [line for line in text.split(b"\n") if line.strip()]
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    return len(words), len(solid) - continued, symbols, len(lines) - len(set(lines)), repeat_words(ids)


def count_ngrams(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", broadcast: int = BROADCAST
) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all documents, and of the trusted ones (quality 1 and, if told, not toxic, in all their labels)."""
    toxic = at(labels, "toxic").cast("int") if "toxic" in labels.columns else F.lit(0)
    known = sealed(labels).select(at(labels, id_column).alias("_id"), at(labels, "quality").cast("int").alias("q"), toxic.alias("t"))
    known = known.filter("_id is not null").groupBy("_id").agg(F.min(F.coalesce("q", F.lit(0))).alias("q"), F.max(F.coalesce("t", F.lit(0))).alias("t"))
    trusted = materialise_table(known.filter("q = 1 and t = 0").select("_id", F.lit(True).alias("_trusted")))
    few = F.broadcast(trusted) if trusted.count() <= broadcast else trusted
    texts = identified(docs, id_column, text_column).join(few, "_id", "left").select("_text", "_trusted")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, trust in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").split()
                if words:
                    found = np.bincount(buckets(*numbered(words)), minlength=BUCKETS)
                    counts[0] += found
                    if trust:
                        counts[1] += found
        some = np.flatnonzero(counts[0])
        yield pa.record_batch([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "raw", "trusted"])

    # At most BUCKETS rows, whatever the corpus.
    found = texts.mapInArrow(rows, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, m in found:
        raw[bucket], target[bucket] = n, m
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, alpha: float = 5.0) -> np.ndarray | None:
    """log(target / raw) by bucket; raw counts are scaled to the target's size, so ``alpha`` weighs alike in both."""
    if not target.any():
        return None
    return np.log((target + alpha) / (raw * (target.sum() / raw.sum()) + alpha))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    docs: DataFrame, ratios: np.ndarray | None, id_column: str = "doc_id", text_column: str = "text", threshold: float = -0.1,
    min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """(id, counts, base_failed, ratio: null without words or without trusted documents, kept) of every row."""
    texts = identified(docs, id_column, text_column).select("_id", "_text")
    schema = texts.select("_id").withColumns({c: F.lit(None).cast("long") for c in COUNTS}).withColumn("ratio", F.lit(None).cast("double")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                ids, hashes = numbered(words)
                counts.append(base_counts(text or b"", words, ids))
                found.append(float(ratios[buckets(ids, hashes)].mean()) if words and ratios is not None else None)
            columns = np.array(counts, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.record_batch([batch.column(0), *map(pa.array, columns), pa.array(found, pa.float64())], names=schema.names)

    out = texts.mapInArrow(rows, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~failed & (F.col("ratio").isNull() | (F.col("ratio") >= threshold))
    return out.select("_id", *COUNTS, failed.alias("base_failed"), "ratio", kept.alias("kept")).toDF(id_column, *COUNTS, "base_failed", "ratio", "kept")
