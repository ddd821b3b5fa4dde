"""Helpers every operator shares: names, types, one-pass aggregates, materialising."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Expressions per aggregate job; the JVM leaves the code of much larger ones unoptimised.
AGG_CHUNK = 64
# Rows, and bytes of text in its keys, a table of group statistics may have and still be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_KEY_BYTES = 32 << 20
# A group is hot when it holds more than one row in this many (so at most this many are hot).
HOT_SHARE = 1000
# Rows up to which a frame is spread over all slots before heavy work.
SPREAD_ROWS = 5_000_000
# Bytes, as the planner estimates them, up to which the same is done without a count.
SPREAD_BYTES = 64 << 20

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGER_TYPES + FLOAT_TYPES + (T.DecimalType,)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def column(name: str) -> Column:
    """Column by its literal name: dots, spaces and backticks are part of the name."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fields_of(df: DataFrame, kinds: tuple[type, ...]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, floating and decimal columns; booleans are not numbers here."""
    return fields_of(df, NUMERIC_TYPES)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """S9. Raise for the first absent name, before any job runs."""
    present = set(df.columns)
    for name in names:
        if name not in present:
            raise ValueError(f"Column '{name}' not found in dataset.")


def reject_nested(df: DataFrame) -> None:
    nested = fields_of(df, NESTED_TYPES)
    if nested:
        raise ValueError(f"Nested columns are not supported here: {', '.join(nested)}")


def names_of(df: DataFrame) -> list[str]:
    """All columns, quoted, for ``select``."""
    return [quoted(c) for c in df.columns]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, so that missing means one thing in every operator."""
    floats = set(fields_of(df, FLOAT_TYPES))
    if not floats:
        return df
    return df.selectExpr(
        *[f"if(isnan({quoted(c)}), null, {quoted(c)}) as {quoted(c)}" if c in floats else quoted(c) for c in df.columns]
    )


def literal(x: float) -> str:
    """A double in SQL text, infinities and signs included, to the last bit."""
    return f"double('{float(x)!r}')"


def as_double(name: str) -> Column:
    return column(name).cast("double")


def aggregate_once(df: DataFrame, exprs: Mapping[object, Column | str]) -> dict:
    """Evaluate global aggregates in as few jobs as AGG_CHUNK allows; keys are free-form."""
    keys, out = list(exprs), {}
    for start in range(0, len(keys), AGG_CHUNK):
        part = keys[start : start + AGG_CHUNK]
        values = [exprs[k] for k in part]
        if all(isinstance(v, str) for v in values):
            row = df.selectExpr(*[f"{v} as a{i}" for i, v in enumerate(values)]).first()
        else:
            row = df.agg(*[v.alias(f"a{i}") for i, v in enumerate(values)]).first()
        out.update(zip(part, row))
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    One of our own is set in local mode only; elsewhere a missing setting raises, because
    without the folder every later pass would compute its input anew.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        if folder is None:
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint a small intermediate frame."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def materialise_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table-sized frame to the shared folder as Parquet, so later scans read few columns.

    Who gives a path of their own (see ``table_path``) can ``discard`` it when done.
    """
    path = path or table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialise_table`` wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Give every task slot a share of a small frame before work that is heavy per row.

    Beyond SPREAD_ROWS a scan has splits enough, and the frame stays as it is.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SPREAD_ROWS else df


def spread_small(df: DataFrame) -> DataFrame:
    """``spread`` by the planner's estimate of a frame's bytes, for heavy expressions over a table that is one split or few."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimate <= SPREAD_BYTES else df


class GroupSizes(NamedTuple):
    """Measures of a one-row-per-group table."""

    groups: int
    rows: int
    largest: int
    key_bytes: int

    @property
    def broadcast(self) -> bool:
        return self.groups <= BROADCAST_ROWS and self.key_bytes <= BROADCAST_KEY_BYTES


def group_sizes(stats: DataFrame, keys: Sequence[str], size: str = "n") -> GroupSizes:
    texts = [k for k in fields_of(stats, (T.StringType,)) if k in keys]
    key_bytes = " + ".join(["0"] + [f"coalesce(octet_length({quoted(k)}), 0)" for k in texts])
    q = quoted(size)
    row = stats.selectExpr("count(*)", f"coalesce(sum({q}), 0)", f"coalesce(max({q}), 0)", f"coalesce(sum(bigint({key_bytes})), 0)")
    return GroupSizes(*row.first())


def join_group_stats(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], size: str, sizes: GroupSizes | None = None
) -> DataFrame:
    """Inner-join rows with a materialised one-row-per-group table.

    A table of checked size is broadcast. A larger one is shuffled, except that the rows
    of hot groups (each above 1/HOT_SHARE of all rows, hence fewer than HOT_SHARE groups)
    meet a broadcast of just those groups, so no task receives a whole hot group.
    """
    keys = list(keys)
    sizes = sizes or group_sizes(stats, keys, size)
    if sizes.broadcast:
        return rows.join(F.broadcast(stats), keys)
    hot = stats.filter(F.col(size) > sizes.rows / HOT_SHARE)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(stats, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A frame of fitted results, whose size is bounded by the schema and not by the data."""
    return spark.createDataFrame(list(rows), schema)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))
