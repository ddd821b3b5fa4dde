"""Reading tables with predictable missing values and types."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import aggregate_once, column, fields_of, nan_to_null
from ..functions.text import TRUE_TOKENS, looks_boolean, looks_float, looks_integer, na_to_null
from .records import SAME, SHUT, csv_records, quoted_lines


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S5. Read by suffix, in any case: csv, xlsx, parquet; a name without one is a table."""
    name = path.rstrip("/").lower()
    try:
        if name.endswith(".csv"):
            return load_csv(spark, path, schema)
        if name.endswith(".parquet"):
            return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError("File not found") from e
        raise
    if name.endswith(".xlsx"):
        from .workbook import load_workbooks

        return load_workbooks(spark, path)
    if "/" not in name and spark.catalog.tableExists(path):
        return spark.table(path)
    raise ValueError("Unsupported file format")


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S1. Comma-separated text with a header row in every file.

    Files of one folder are matched by column name; different sets of names raise. A line
    with more cells than its header raises, with the line; one with fewer ends in nulls.
    Quoted cells may hold line breaks, and files are read in splits all the same (see ``csv_records``). A quote that
    is still open at a file's end raises.
    """
    try:
        plain, broken = _files_by_header(spark, path)
        groups = [(h, _read_cells(spark, h, files)) for h, files in plain] + [(h, _parse_records(h, records)) for h, records in broken]
        if not groups:
            raise ValueError("No columns to parse from file")
        names = header_names(groups[0][0])
        for header, _ in groups[1:]:
            if sorted(header_names(header)) != sorted(names):
                raise ValueError(f"Files differ in their columns: {', '.join(names)} and {', '.join(header_names(header))}")
        raw = groups[0][1]
        for _, part in groups[1:]:
            raw = raw.unionByName(part)
        raw = normalise_na(raw)
        if schema is None:
            return infer_types(raw)
        wanted = {f.name: f.dataType for f in schema.fields}
        return raw.select(*[column(c).cast(wanted[c]).alias(c) if c in wanted else column(c) for c in raw.columns])
    except ValueError as e:
        raise ValueError(f"CSV Error: {e}") from e
    except SparkRuntimeException as e:
        if e.getCondition() != "USER_RAISED_EXCEPTION":
            raise
        raise ValueError(f"CSV Error: {e.getMessageParameters()['errorMessage']}") from e


def _cells_of(header: str) -> list[str]:
    return next(csv.reader(io.StringIO(header.lstrip("\ufeff"), newline="")), [])


def _files_by_header(spark: SparkSession, path: str):
    """Groups (header cells, files) of files without line breaks in quotes, and (header cells, records) of those with, from one pass over the lines."""
    lines = quoted_lines(spark, path)
    first = F.struct("block", "line")
    files = lines.groupBy("file").agg(
        F.min_by(F.struct("value", "turn"), first).alias("top"), F.bool_or(F.col("turn") != SAME).alias("broken")
    )
    top = F.when(F.col("top.turn").isin(SAME, SHUT), F.substring_index("top.value", "\r", 1)).alias("header")
    found = files.select("file", top, "broken").groupBy("header", "broken").agg(F.collect_list("file").alias("files")).collect()
    plain = [(_cells_of(r["header"]), sorted(r["files"])) for r in found if r["header"] and not r["broken"]]
    whole = []
    for r in found:
        if r["header"] != "" and r["broken"]:
            records = csv_records(spark, sorted(r["files"]))
            if r["header"] is not None:
                whole.append((_cells_of(r["header"]), records))
                continue
            # The header itself goes over several lines; such files are told apart by it once more.
            for h in records.filter("first").groupBy("value").agg(F.collect_list("file").alias("files")).collect():
                whole.append((_cells_of(h["value"].rstrip("\r")), records.filter(F.col("file").isin(h["files"]))))
    return sorted(plain, key=lambda g: g[1]), whole


def _places(header: list[str]) -> tuple[list[str], list[str], str]:
    names = header_names([cell or None for cell in header])
    return names, [f"c{i}" for i in range(len(names))], ", ".join(f"{c} string" for c in [*(f"c{i}" for i in range(len(names))), SPARE])


# Column that takes the text of a line that does not fit its header.
SPARE = "line"
CSV_OPTIONS = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": SPARE}


def _read_cells(spark: SparkSession, header: list[str], files: list[str]) -> DataFrame:
    """All cells as text. A line with more cells than the header raises when it is read."""
    names, places, schema = _places(header)
    reader = spark.read.options(header=True, enforceSchema=True, encoding="UTF-8", **CSV_OPTIONS)
    return _fitting(reader.schema(schema).csv(files), names, places)


def _parse_records(header: list[str], records: DataFrame) -> DataFrame:
    """As ``_read_cells``, of records put together from lines."""
    names, places, schema = _places(header)
    rows = records.filter("not first").select(F.regexp_replace("value", "\r$", "").alias("value")).filter("trim(value) <> ''")
    return _fitting(rows.select(F.from_csv("value", schema, CSV_OPTIONS).alias("cells")).select("cells.*"), names, places)


def _fitting(cells: DataFrame, names: list[str], places: list[str]) -> DataFrame:
    # Cells of a line that does not fit, counted by the commas outside its quotes.
    bare = F.regexp_replace(SPARE, '"(?:[^"]++|"")*+"', "")
    extra = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1 > len(names)
    problem = F.concat(F.lit(f"Expected {len(names)} cells: "), F.col(SPARE))
    checked = F.when(extra, F.raise_error(problem).cast("string")).otherwise(F.col(places[0])) if places else None
    return cells.select(*([checked, *places[1:]] if places else [])).toDF(*names)


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Blank headers become ``Unnamed: k``; repeats get ``.1``, ``.2``, skipping names in use."""
    names = [f"Unnamed: {i}" if cell is None or cell == "" else cell for i, cell in enumerate(cells)]
    taken, seen, out = set(names), {}, []
    for name in names:
        fresh = name
        while name in seen and (fresh in taken or fresh == name):
            fresh = f"{name}.{seen[name]}"
            seen[name] += 1
        if name not in seen:
            seen[name] = 1
        taken.add(fresh)
        out.append(fresh)
    return out


def normalise_na(df: DataFrame) -> DataFrame:
    """S2. Missing-value texts and NaN become NULL."""
    texts = set(fields_of(df, (T.StringType,)))
    out = df.select(*[na_to_null(column(c)).alias(c) if c in texts else column(c) for c in df.columns])
    return nan_to_null(out)


def inferred_types(df: DataFrame) -> dict[str, str]:
    """S3. Type of each text column from all its values: bigint, double, boolean or string."""
    exprs = {}
    for c in fields_of(df, (T.StringType,)):
        v = column(c)
        exprs[c, "n"] = F.count(v)
        exprs[c, "int"] = F.count(F.when(looks_integer(v), F.trim(v).try_cast("bigint")))
        exprs[c, "float"] = F.count_if(looks_float(v))
        exprs[c, "bool"] = F.count_if(looks_boolean(v))
    counts = aggregate_once(df, exprs)
    types = {}
    for c in fields_of(df, (T.StringType,)):
        n = counts[c, "n"]
        if n == 0 or n == counts[c, "float"] != counts[c, "int"]:
            types[c] = "double"
        elif n == counts[c, "int"]:
            types[c] = "bigint"
        else:
            types[c] = "boolean" if n == counts[c, "bool"] else "string"
    rows = df.count() if "boolean" in types.values() else None
    # A boolean column with a gap stays text, as a mixed column would.
    return {c: "string" if t == "boolean" and counts[c, "n"] < rows else t for c, t in types.items()}


def infer_types(df: DataFrame) -> DataFrame:
    """S3. Cast text columns to the type all their values share."""
    types = inferred_types(df)

    def typed(c):
        if types.get(c) in ("bigint", "double"):
            return F.trim(column(c)).try_cast(types[c]).alias(c)
        if types.get(c) == "boolean":
            return F.when(column(c).isNotNull(), column(c).isin(*TRUE_TOKENS)).alias(c)
        return column(c)

    return df.select(*[typed(c) for c in df.columns])


def preview(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """S10. The first rows; give a key for an answer that does not depend on the layout."""
    return (df.orderBy(*[column(c) for c in order]) if order else df).limit(n)
