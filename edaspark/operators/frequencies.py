"""Distinct values with their counts, and what follows from them: mode, top values, distinctness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import BROADCAST_ROWS, FLOAT_TYPES, INTEGER_TYPES, column, materialise, quoted


# Bytes beyond which a text is counted by its digest.
LONG_TEXT = 64
# Bytes beyond which a frequent text is, and the characters of it that stand for it in an order; so many bytes are more characters than these.
LONG_VALUE, HEAD = 256, 64


def as_text(df: DataFrame, name: str) -> Column:
    """Value as text, one text per distinct value."""
    c = column(name)
    if isinstance(df.schema[name].dataType, FLOAT_TYPES):
        c = c + F.lit(0.0)
    return c.cast("string")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for non-null values as text; counted before the shuffle."""
    columns = list(columns)
    texts = df.select(*[as_text(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    long = texts.unpivot([], texts.columns, "slot", "value").filter("value is not null")
    label = F.element_at(F.array(*map(F.lit, columns)), F.substring("slot", 2, 9).cast("int") + 1)
    return long.groupBy("slot", "value").agg(F.count("*").alias("n")).select(label.alias("column"), "value", "n")


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(slot, value, head, digest)`` of non-null values as text: a long text has its first characters as head and a digest, another is its own head."""
    texts = df.select(*[as_text(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"{i}, v{i}" for i in range(len(columns)))
    long = texts.selectExpr(f"stack({len(columns)}, {pairs}) as (slot, value)").filter("value is not null")
    beyond = F.octet_length("value") > LONG_VALUE
    head = F.when(beyond, F.substring("value", 1, HEAD)).otherwise(F.col("value"))
    return long.select("slot", "value", head.alias("head"), F.when(beyond, F.sha2("value", 256)).otherwise("").alias("digest"))


def _labelled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("column", F.element_at(F.array(*map(F.lit, columns)), F.col("slot") + 1))


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, slot, head, digest, n)`` of the distinct non-null values, without shuffling long texts."""
    counts = _keyed(df, columns).groupBy("slot", "head", "digest").agg(F.count("*").alias("n"))
    return _labelled(counts, columns).select("column", "slot", "head", "digest", "n")


def top_of(df: DataFrame, columns: Sequence[str], counts: DataFrame, k: int) -> DataFrame:
    """``(column, rank, value, n)``: the k most frequent values of each column, the smaller on ties, from their ``key_counts``.

    Counts and first characters leave the first k, and those that tie with the last of them in both. The whole texts of only these are
    fetched, by a second pass in which every task first combines its own copies of a text.
    """
    near = Window.partitionBy("slot").orderBy(F.desc("n"), F.substring("head", 1, HEAD))
    order = Window.partitionBy("slot").orderBy(F.desc("n"), F.asc("head"))
    first = materialise(counts.withColumn("rank", F.rank().over(near)).filter(F.col("rank") <= k).drop("rank"))
    wanted = first.filter("digest <> ''").select("slot", "digest")
    n = wanted.count()
    if n:
        few = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
        texts = _keyed(df, columns).filter("digest <> ''").join(few, ["slot", "digest"], "left_semi")
        texts = texts.groupBy("slot", "digest").agg(F.min("value").alias("text"))
        first = first.join(texts, ["slot", "digest"], "left").withColumn("head", F.coalesce("text", "head"))
    top = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("column", "rank", F.col("head").alias("value"), "n")


def top_counts(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """``(column, rank, value, n)``: the k most frequent values of each column as text, the smaller on ties."""
    columns = list(columns)
    return top_of(df, columns, key_counts(df, columns), k)


def distinct_counts(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Distinct non-null values, and how many of them occur once, for every column.

    Whole numbers, fractions and everything else are counted apart, each in their own type.
    """
    kinds: dict[str, list[tuple[str, str]]] = {}
    for field in df.schema.fields:
        q = quoted(field.name)
        if isinstance(field.dataType, INTEGER_TYPES):
            kinds.setdefault("whole", []).append((field.name, f"bigint({q})"))
        elif isinstance(field.dataType, FLOAT_TYPES):
            kinds.setdefault("fraction", []).append((field.name, f"double({q}) + 0"))
        else:
            # Long texts are told apart by their SHA-256, so that they need not be shuffled.
            text = f"if(octet_length(string({q})) > {LONG_TEXT}, concat('#', sha2(string({q}), 256)), concat('=', string({q})))"
            kinds.setdefault("text", []).append((field.name, text))
    out = {c: (0, 0) for c in df.columns}
    for named in kinds.values():
        pairs = ", ".join(f"{i}, {expression}" for i, (_, expression) in enumerate(named))
        long = df.selectExpr(f"stack({len(named)}, {pairs}) as (k, v)").filter("v is not null")
        counts = long.groupBy("k", "v").agg(F.count("*").alias("n"))
        for k, distinct, once in counts.groupBy("k").agg(F.count("*"), F.count_if(F.col("n") == 1)).collect():
            out[named[k][0]] = (distinct, once)
    return out


def top_values(counts: DataFrame, k: int, keys: Sequence[str] = ("column",)) -> DataFrame:
    """Top k by count, ties by value. The rank limit is applied before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def modes(df: DataFrame, values: Mapping[str, Column]) -> dict[str, str | None]:
    """Most frequent non-null value of each expression as text, the smallest on ties; one job per type among them."""
    names = list(values)
    wide = df.select(*[values[c].alias(f"v{i}") for i, c in enumerate(names)])
    kinds: dict[str, list[int]] = {}
    for i, field in enumerate(wide.schema.fields):
        whole, part = isinstance(field.dataType, INTEGER_TYPES), isinstance(field.dataType, FLOAT_TYPES)
        kinds.setdefault("bigint" if whole else "double" if part else field.dataType.simpleString(), []).append(i)
    out: dict[str, str | None] = dict.fromkeys(names)
    for kind, members in kinds.items():
        pairs = ", ".join(f"{i}, cast(v{i} as {kind})" for i in members)
        long = wide.selectExpr(f"stack({len(members)}, {pairs}) as (k, v)").filter("v is not null")
        counts = long.groupBy("k", "v").agg(F.count("*").alias("n"))
        best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("n"), "v")).cast("string").alias("v"))
        out |= {names[r["k"]]: r["v"] for r in best.collect()}
    return out
