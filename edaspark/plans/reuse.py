"""Stages that are made once for a plan over files that have not changed.

A stage is kept under a fingerprint of the plan that makes it and of the files that the plan reads: their names, lengths and
times of change. The same call over the same files finds the stage and reads no raw file; a file that was added, taken away or
written anew gives another fingerprint. Plans are compared in canonical form, so names of columns made on the way don't matter, and
plans that read other than files (in-memory rows, say) are told apart by what their form says of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..common import discard


def file_versions(df: DataFrame) -> list[tuple[str, int, int]]:
    """(file, length, time of change) of all files a frame reads; one listing per folder, no job."""
    spark = df.sparkSession
    files = set(df.inputFiles())
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        at = path(spark._jvm.java.net.URI(folder))
        for status in at.getFileSystem(conf).listStatus(at):
            name = status.getPath().toUri().toString()
            found.append((name, status.getLen(), status.getModificationTime()))
    wanted = {spark._jvm.java.net.URI(f).getPath() for f in files}
    return sorted(x for x in found if spark._jvm.java.net.URI(x[0]).getPath() in wanted)


def fingerprint(df: DataFrame, *parts: object) -> str:
    """Of the frame's plan, its schema, the versions of its files, and whatever else decides the stage."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    text = repr((df.semanticHash(), plan, df.schema.json(), file_versions(df), parts))
    return hashlib.sha256(text.encode()).hexdigest()


class StageStore:
    """Stages as Parquet tables in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, df: DataFrame, stage: str, *parts: object) -> str:
        return f"{self.folder}/{stage}-{fingerprint(df, stage, *parts)}"

    def holds(self, path: str) -> bool:
        """Whether a stage was written to its end."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def get(self, df: DataFrame, stage: str, make: Callable[[DataFrame], DataFrame], *parts: object) -> DataFrame:
        """The stage that ``make`` gives for the frame, kept from an earlier call where there was one; ``parts`` are what else it depends on."""
        path = self.path(df, stage, *parts)
        if not self.holds(path):
            made = make(df)
            made.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(made.schema).parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, df: DataFrame, stage: str, *parts: object) -> None:
        discard(self.spark, self.path(df, stage, *parts))
