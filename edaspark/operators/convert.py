"""Trimming, casting, date detection and narrowing."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import aggregate_once, column, fields_of, materialise, nan_to_null, quoted, spread_small
from ..functions.text import DATE_LAYOUTS, DATE_LENGTH, date_form, parsed_time, strip

# Type names a user may give, besides Spark's own.
TYPE_NAMES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint",
    "float32": "float", "float64": "double", "float": "double", "str": "string", "object": "string",
    "category": "string", "bool": "boolean", "datetime64[ns]": "timestamp_ntz", "datetime64": "timestamp_ntz",
}
INTEGER_RANGES = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))
FLOAT_TOLERANCE = 5e-4


def trim_strings(df: DataFrame) -> DataFrame:
    """P2. Strip white space of every kind from text columns; a null stays null."""
    texts = fields_of(df, (T.StringType,))
    return df.withColumns({c: strip(column(c)) for c in texts}) if texts else df


def cast_columns(df: DataFrame, schema: Mapping[str, str | T.DataType]) -> DataFrame:
    """P3. Cast the listed columns that exist. A value that does not fit raises.

    As a boolean, a text is true unless it is empty, whatever it says.
    """
    texts = set(fields_of(df, (T.StringType,)))

    def cast(name):
        if name not in schema:
            return column(name)
        wanted = schema[name]
        wanted = TYPE_NAMES.get(wanted, wanted) if isinstance(wanted, str) else wanted.simpleString()
        c = column(name)
        if wanted == "boolean" and name in texts:
            return (c != "").alias(name)
        bad = c.isNotNull() & c.try_cast(wanted).isNull()
        problem = F.concat(F.lit(f"Cannot convert column {name} to {wanted}: "), c.cast("string"))
        return F.when(bad, F.raise_error(problem).cast(wanted)).otherwise(c.try_cast(wanted)).alias(name)

    return df.select(*[cast(c) for c in df.columns])


@dataclass(frozen=True)
class TextForm:
    """Texts of one form (see ``date_form``), with the least and greatest number at each place; None is the form of all long texts."""

    form: str | None
    low: list[int]
    high: list[int]

    def fits(self, shape: str) -> bool:
        """Whether all texts have the shape: numbers of a form are independent in it, and each must lie in an interval."""
        return self.form is not None and all(re.match(shape, self._filled(side)) for side in (self.low, self.high))

    def _filled(self, numbers: list[int]) -> str:
        places = iter(numbers)
        return re.sub("9+", lambda m: str(next(places)).zfill(len(m[0])), self.form)

    def valid_but_for_days(self, layout: str) -> bool:
        """Whether fitting the layout's shape is enough up to the 28th: no names, no year zero, no zone beyond 18 hours."""
        parts = re.findall(r"([A-Za-z])\1*", re.sub("'[^']*'", "", layout))
        numbers = [p for p in dict.fromkeys(parts) if p not in "aX"]
        zone = self.high[len(numbers) :]
        if "MMM" in layout or len(zone) not in ((0, 2) if "X" in parts else (0,)) or len(self.high) < len(numbers):
            return False
        return self.low[numbers.index("y")] > 0 and (not zone or (zone[0] < 18 and zone[1] < 60))

    def surely_valid(self, layout: str) -> bool:
        """Whether fitting the layout's shape is enough: no names, no day beyond the 28th, no year zero."""
        numbers = dict.fromkeys(re.findall(r"([A-Za-z])\1*", re.sub("'[^']*'", "", layout)))
        return self.valid_but_for_days(layout) and ("d" not in numbers or self.high[list(numbers).index("d")] <= 28)


# Numbers a text of DATE_LENGTH has at most.
DATE_NUMBERS = DATE_LENGTH // 2
# Forms a layout has at most, and more: a column with more of them is no date.
MOST_FORMS = 1000
# A number that may be a day which not every month has.
LATE_DAY = "(?<![0-9])(29|30|31)(?![0-9])"


def _alike(texts: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Texts of one length (rows of bytes) by their form with 9 for every digit."""
    forms = np.where((texts >= 48) & (texts <= 57), np.uint8(57), texts)
    for _ in range(16):  # a column of dates has few forms of a length
        same = (forms == forms[0]).all(1)
        yield bytes(forms[0]).decode(errors="replace"), texts[same]
        texts, forms = texts[~same], forms[~same]
        if not len(texts):
            return
    found, place = np.unique(np.ascontiguousarray(forms).view(f"V{forms.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(place, kind="stable")
    for form, own in zip(found, np.split(order, np.cumsum(np.bincount(place))[:-1])):
        yield bytes(form).decode(errors="replace"), texts[own]


def _forms_of(texts: pa.Array) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """(form, least, greatest number at each place) of non-null texts; None is the form of those beyond DATE_LENGTH."""
    short = texts.filter(pc.less_equal(pc.utf8_length(texts), DATE_LENGTH))
    if len(short) < len(texts):
        yield None, np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(short):
        return
    short = pa.concat_arrays([short.cast(pa.large_binary())])
    ends = np.frombuffer(short.buffers()[1], np.int64)[short.offset : short.offset + len(short) + 1]
    data = np.frombuffer(short.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    for size in np.unique(sizes).tolist():
        if not size:
            yield "", np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        for form, own in _alike(data[ends[:-1][sizes == size][:, None] + np.arange(size)]):
            runs = [m.span() for m in re.finditer(b"9+", form.encode())]
            numbers = [(own[:, max(a, b - 18) : b].astype(np.int64) - 48) @ 10 ** np.arange(min(b - a, 18) - 1, -1, -1) for a, b in runs]
            yield form, *(np.array([f(x) for x in numbers], np.int64) for f in (np.min, np.max))


def _text_forms(df: DataFrame, names: list[str]) -> dict[str, list[TextForm]]:
    """The forms of the non-null texts of each column, counted together in one pass; none of a column with more than MOST_FORMS.

    Texts of a length and form stand in one matrix of bytes, whose columns make the numbers; names of months are made alike on forms.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = [{} for _ in names]
        for batch in batches:
            for own, cells in zip(found, batch.columns):
                if len(own) > MOST_FORMS:
                    continue
                for form, low, high in _forms_of(cells.drop_null()):
                    form = None if form is None else date_form(form)
                    known = own.get(form)
                    own[form] = (low, high) if known is None else (np.minimum(low, known[0]), np.maximum(high, known[1]))
        for k, own in enumerate(found):
            sides = [pa.array([x[side].tolist() for x in own.values()], pa.list_(pa.int64())) for side in (0, 1)]
            yield pa.record_batch([pa.array([k] * len(own), pa.int32()), pa.array(list(own), pa.string()), *sides], names=["k", "form", "low", "high"])

    found = df.select(*[column(c).alias(f"v{i}") for i, c in enumerate(names)]).mapInArrow(rows, "k int, form string, low array<long>, high array<long>")
    ends = [[f(F.get(x, F.lit(i))) for i in range(DATE_NUMBERS)] for f, x in ((F.min, "low"), (F.max, "high"))]
    found = materialise(found.groupBy("k", "form").agg(*[F.array_compact(F.array(*e)).alias(x) for e, x in zip(ends, ("low", "high"))]))
    few = [k for k, n in found.groupBy("k").count().collect() if n <= MOST_FORMS]
    out: dict[str, list[TextForm]] = {c: [] for c in names}
    for row in found.filter(F.col("k").isin(few)).collect():
        out[names[row["k"]]].append(TextForm(row["form"], row["low"], row["high"]))
    return out


@dataclass(frozen=True)
class DatePlan:
    """P5. Text columns whose every value is a date in one layout."""

    layouts: tuple[tuple[str, str, str], ...]

    @classmethod
    def fit(cls, df: DataFrame) -> DatePlan:
        texts = fields_of(df, (T.StringType,))
        if not texts:
            return cls(())
        # A layout must fit any one value, so only columns that can pass are looked at in full.
        heads = _one_value_each(df, texts)
        able = [c for c in texts if heads[c] is not None and any(re.match(shape, heads[c]) for shape, _ in DATE_LAYOUTS)]
        if not able:
            return cls(())
        spread_ = spread_small(df.select(*[column(c) for c in able]))
        forms = _text_forms(spread_, able)
        found, doubtful = {}, {}
        for c, own in forms.items():
            fitting = [(shape, x) for shape, x in DATE_LAYOUTS if own and all(f.fits(shape) for f in own)]
            if fitting and all(f.surely_valid(fitting[0][1]) for f in own):
                found[c] = fitting[0]
            elif fitting:
                doubtful[c] = fitting
        # Only names of months, and days that not every month has, are left to a parse.
        exprs = {}
        for c, fitting in doubtful.items():
            for shape, layout in fitting:
                only_days = all(f.valid_but_for_days(layout) for f in forms[c])
                asked = column(c).rlike(LATE_DAY) if only_days else column(c).isNotNull()
                exprs[c, layout] = F.count_if(asked & parsed_time(column(c), shape, layout).isNull())
        failed = aggregate_once(spread_, exprs)
        for c, fitting in doubtful.items():
            full = [(shape, x) for shape, x in fitting if failed[c, x] == 0]
            if full:
                found[c] = full[0]
        return cls(tuple((c, *found[c]) for c in able if c in found))

    def apply(self, df: DataFrame) -> DataFrame:
        found = {c: (shape, layout) for c, shape, layout in self.layouts}
        return (spread_small(df) if found else df).select(
            *[parsed_time(column(c), *found[c]).alias(c) if c in found else column(c) for c in df.columns]
        )


def _one_value_each(df, names):
    """Some non-null value of each column, from the first rows where they have one."""
    head = df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(names)]).limit(1000)
    found = aggregate_once(head, {c: F.first(f"c{i}", ignorenulls=True) for i, c in enumerate(names)})
    rest = [c for c, v in found.items() if v is None]
    if rest:
        found |= aggregate_once(df, {c: F.min(column(c)) for c in rest})
    return found


def detect_dates(df: DataFrame) -> DataFrame:
    """P5. Fit and apply date detection."""
    return DatePlan.fit(df).apply(df)


@dataclass(frozen=True)
class NarrowPlan:
    """P4. Narrowest types that hold every value: integers by range, doubles by loss."""

    types: tuple[tuple[str, str], ...]

    @classmethod
    def fit(cls, df: DataFrame) -> NarrowPlan:
        df = nan_to_null(df)
        longs, doubles = fields_of(df, (T.LongType,)), fields_of(df, (T.DoubleType,))
        exprs = {}
        for c in longs:
            exprs[c, "lo"], exprs[c, "hi"] = F.min(column(c)), F.max(column(c))
        for c in doubles:
            loss = F.abs(column(c) - column(c).cast("float").cast("double"))
            lossy = (column(c).cast("float").cast("double") != column(c)) & ~(loss <= FLOAT_TOLERANCE)
            exprs[c, "lossy"] = F.count_if(lossy)
            exprs[c, "n"] = F.count(column(c))
        found = aggregate_once(df, exprs)
        types = []
        for c in longs:
            lo, hi = found[c, "lo"], found[c, "hi"]
            fitting = [t for t, top in INTEGER_RANGES if lo is not None and -top <= lo and hi < top]
            types += [(c, fitting[0])] if fitting else []
        types += [(c, "float") for c in doubles if found[c, "n"] > 0 and found[c, "lossy"] == 0]
        return cls(tuple(types))

    def apply(self, df: DataFrame) -> DataFrame:
        types = dict(self.types)
        return df.select(*[column(c).cast(types[c]).alias(c) if c in types else column(c) for c in df.columns])


def narrow(df: DataFrame) -> DataFrame:
    """P4. Fit and apply narrowing."""
    return NarrowPlan.fit(df).apply(df)


def convert_types(df: DataFrame, schema: Mapping[str, str] | None = None, narrowing: bool = True) -> DataFrame:
    """P2-P5 in the order trim, cast, detect dates, narrow."""
    df = trim_strings(df)
    if schema:
        df = cast_columns(df, schema)
    df = detect_dates(df)
    return narrow(df) if narrowing else df
