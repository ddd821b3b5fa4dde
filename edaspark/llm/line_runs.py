"""Repeated lines dropped through levelled sorted runs of line hashes.

Documents go in batches of falling id. A batch's line keys are anti-joined with the runs; the
keys that no run holds become a new sorted run with the largest id that has them, the others
add their counts to it. ``fanout`` runs of a level are merged into one of the next. The first
batch to bring a key thus names its holder, and merged counts tell how many documents have it.
Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all lines
but the holder's.

A key is a line without the white space around it, with A-Z in lower case; hashes are 128 bits.
Documents are told apart by id: repeated rows of one id count once and share its fate. A null
id is the smallest id. A null text is one empty line. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialise_table, shared_folder
from .common import SPACES_TEXT, at, lower_ascii, sealed

KEY = ["h1", "h2"]


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES_TEXT))


def _hashes(stripped: Column) -> Column:
    key = lower_ascii(stripped)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Sorted runs (h1, h2, holder, n) in a shared folder, in levels."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def runs(self, paths: Sequence[str] | None = None) -> DataFrame:
        paths = [p for level in self.levels for p in level] if paths is None else list(paths)
        schema = "h1 long, h2 long, holder long, n long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, run: DataFrame) -> str:
        path = f"{self.folder}/run-{self.written}"
        self.written += 1
        run.repartition(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def add(self, keys: DataFrame) -> None:
        """Take a batch's (h1, h2, holder, n), one row per key."""
        held = self.runs().filter("holder is not null").select(*KEY)
        if self.written:
            keys = materialise_table(keys)
            fresh = keys.join(held, KEY, "left_anti")
            known = keys.join(held, KEY, "left_semi").select(*KEY, F.lit(None).cast("long").alias("holder"), "n")
            keys = fresh.unionByName(known)
        self.levels[0].append(self._write(keys))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self.merged(self.runs(level))))
                level.clear()

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy(*KEY).agg(F.max("holder").alias("holder"), F.sum("n").alias("n"))


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40, min_docs: int = 5,
    batches: int = 5, fanout: int = 3,
) -> DataFrame:
    """All columns, the text without dropped lines, and n_lines, n_dropped of every row."""
    spark = docs.sparkSession
    names, plain = [c for c in docs.columns if c not in ("n_lines", "n_dropped")], sealed(docs)
    id_, text = F.coalesce(at(docs, id_column).cast("long"), F.lit(-(1 << 63))), at(docs, text_column).cast("string")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    held = plain.select(id_.alias("_id"), F.explode(F.array_distinct(F.transform(lines, _stripped))).alias("_key"))
    held = held.filter(F.char_length("_key") >= min_chars).select("_id", _hashes(F.col("_key")).alias("_h")).select("_id", "_h.*")
    steps = [k / batches for k in range(1, batches)]
    cuts = plain.select(F.percentile_approx(id_, steps, 1000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    batch = sum((F.when(F.col("_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    held = materialise_table(held.withColumn("_batch", batch))

    runs = LineRuns(spark, fanout)
    for k in range(len(cuts), -1, -1):
        own = held.filter(F.col("_batch") == k).groupBy(*KEY)
        runs.add(own.agg(F.max("_id").alias("holder"), F.count_distinct("_id").alias("n")))
    frequent = materialise_table(runs.merged(runs.runs()).filter(F.col("n") >= min_docs).select(*KEY, "holder"))
    drops = held.join(frequent, KEY).filter("_id <> holder").groupBy("_id").agg(F.collect_set(F.struct(*KEY)).alias("_drops"))

    whole = plain.select(*[at(docs, c) for c in names], id_.alias("_id")).join(drops, "_id", "left")
    long = lambda line: F.char_length(_stripped(line)) >= min_chars
    stays = lambda line: ~(long(line) & F.array_contains(F.col("_drops"), _hashes(_stripped(line))))
    whole = whole.withColumn("_kept", F.when(F.col("_drops").isNull(), lines).otherwise(F.filter(lines, stays)))
    return whole.select(
        *[F.array_join("_kept", "\n") if c == text_column else at(docs, c) for c in names],
        F.size(lines).cast("long"),
        (F.size(lines) - F.size("_kept")).cast("long"),
    ).toDF(*names, "n_lines", "n_dropped")
