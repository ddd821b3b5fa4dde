"""From raw documents to encoded, deduplicated, decontaminated text, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edaspark.common import shared_folder
from edaspark.llm.common import fold_of
from edaspark.llm.decontaminate import drop_contaminated
from edaspark.llm.line_runs import drop_repeated_lines
from edaspark.llm.piece_dropout import encode
from edaspark.llm.quadratic_quality import fit_quality, score_quality
from edaspark.llm.simhash_anchors import keep_one_of_each

GOOD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD; labels of the held-out fold teach nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.filter(fold_of(F.col("doc_id"), 4) != 2))
    return score_quality(docs, model, score_column="_score").filter(F.col("_score") >= GOOD).drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more in five documents stay in the last only; n_chars follows the text."""
    kept = drop_repeated_lines(docs).drop("n_lines", "n_dropped")
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the vocabulary's pieces beside the documents' columns."""
    return encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", pieces),
]

# The classifier and the segmentation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
