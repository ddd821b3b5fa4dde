"""Repeated rows, found without shuffling whole rows.

Only a 64-bit hash of each row is shuffled. Rows whose hash is alone are certainly
unique; the others are compared in full, so a hash collision changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import FLOAT_TYPES, SPREAD_ROWS, column, fields_of, materialise, names_of, nan_to_null, quoted
from .moments import gap_masks

# Repeated hashes (eight bytes each) that may be broadcast.
BROADCAST_HASHES = 1_000_000


def _hash_name(df: DataFrame) -> str:
    name = "row_hash"
    while name in df.columns:
        name += "_"
    return name


def _hashed(df: DataFrame) -> DataFrame:
    floats = set(fields_of(df, FLOAT_TYPES))
    # Adding zero makes -0.0 and 0.0 hash alike; the null flags keep (1, null) from (null, 1).
    values = [f"{quoted(c)} + 0" if c in floats else quoted(c) for c in df.columns]
    return df.selectExpr(*names_of(df), f"xxhash64({', '.join(values + gap_masks(df.columns))}) as {_hash_name(df)}")


def _repeated_hashes(df: DataFrame) -> tuple[DataFrame | None, int]:
    """Hashes that occur more than once, and how many."""
    name = _hash_name(df)
    hashes = materialise(_hashed(df).groupBy(name).count().filter("count > 1").select(name))
    return hashes, hashes.count()


def _suspects(df: DataFrame) -> DataFrame | None:
    """Rows that may have a copy; None when there are none. With too many repeated hashes to broadcast, that is all rows.

    A join on the hash would shuffle all rows as well, and all copies of one row to one task. What follows groups
    rows by their values, where each task first combines the copies it holds.
    """
    hashes, n = _repeated_hashes(df)
    if n == 0:
        return None
    if n > BROADCAST_HASHES:
        return df
    return _hashed(df).join(F.broadcast(hashes), _hash_name(df), "left_semi").select(*names_of(df))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every row value that occurs more than once, with ``copies``."""
    df = nan_to_null(df)
    suspects = _suspects(df)
    return _repeated(df.filter(F.lit(False)) if suspects is None else suspects)


def _repeated(df: DataFrame) -> DataFrame:
    name = copies_name(df)
    return df.groupBy(*names_of(df)).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def copies_name(df: DataFrame) -> str:
    """``copies``, or that with underscores where the table has such a column."""
    name = "copies"
    while name in df.columns:
        name += "_"
    return name


def duplicate_count(df: DataFrame) -> int:
    """V3. Rows equal to an earlier row on all columns; a null equals a null."""
    df = nan_to_null(df)
    suspects = _suspects(df)
    if suspects is None:
        return 0
    return _repeated(suspects).agg(F.coalesce(F.sum(F.col(copies_name(df)) - 1), F.lit(0))).first()[0]


def top_duplicates(df: DataFrame, k: int = 10) -> DataFrame:
    """D9. The k most repeated rows."""
    order = [F.desc(copies_name(df))] + [column(c).asc() for c in df.columns]
    return duplicate_groups(df).orderBy(*order).limit(k)


def remove_duplicates(df: DataFrame, rows: int | None = None) -> DataFrame:
    """P6. Keep one of each group of equal rows.

    Rows without a possible copy pass through; only the others are shuffled. Beyond BROADCAST_HASHES repeated
    values, or where ``rows`` is known to be few, all rows are grouped by their values, copies first inside each task.
    """
    df = nan_to_null(df)
    if rows is not None and rows <= SPREAD_ROWS:
        return df.distinct()
    hashes, n = _repeated_hashes(df)
    if n == 0:
        return df
    if n > BROADCAST_HASHES:
        return df.distinct()
    name, names = _hash_name(df), names_of(df)
    hashed, few = _hashed(df), F.broadcast(hashes)
    alone = hashed.join(few, name, "left_anti").select(*names)
    copied = hashed.join(few, name, "left_semi").select(*names)
    return alone.unionByName(copied.distinct())
