"""Column expressions over text: missing-value tokens, trimming, number and date shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a CSV reader takes for a missing value.
NA_TOKENS = (
    "", "NA", "N/A", "n/a", "NaN", "nan", "-nan", "-NaN", "NULL", "null", "None", "<NA>",
    "#N/A", "#N/A N/A", "#NA", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)
# Texts read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"

# All Unicode white space plus the four ASCII separators, at either end.
# The look-behind keeps long runs inside a text from being tried at each of their places.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]+$"

_YEAR, _MONTH, _DAY = "[0-9]{4}", "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
_CLOCK = "([01]?[0-9]|2[0-3]):[0-5][0-9]"
_SECONDS = f"{_CLOCK}:[0-5][0-9]"
_FRACTION = r"\.[0-9]{1,6}"
_DIGITS = ".[SSSSSS][SSSSS][SSSS][SSS][SS][S]"
_HALF_DAY = "(0?[1-9]|1[0-2]):[0-5][0-9]"
_HALF = "([AaPp][Mm])"
_ZONE = "(Z|[+-][0-9]{2}:[0-9]{2})"
_SHORT_YEAR = "[0-9]{2}"
# Two-digit years from this one on are of the last century.
FIRST_OF_LAST_CENTURY = 69

# Date layouts with the shape of text each fits; month-first stands before day-first.
# The shapes leave little to fail in parsing, where a failure costs an exception.
DATE_LAYOUTS = tuple(
    (f"^{shape}$", layout)
    for shape, layout in (
        (f"{_YEAR}-{_MONTH}-{_DAY}", "yyyy-M-d"),
        (f"{_YEAR}-{_MONTH}-{_DAY} {_CLOCK}", "yyyy-M-d H:mm"),
        (f"{_YEAR}-{_MONTH}-{_DAY} {_SECONDS}", "yyyy-M-d H:mm:ss"),
        (rf"{_YEAR}-{_MONTH}-{_DAY} {_SECONDS}\.[0-9]{{1,6}}", "yyyy-M-d H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
        (f"{_YEAR}-{_MONTH}-{_DAY}T{_CLOCK}", "yyyy-M-d'T'H:mm"),
        (f"{_YEAR}-{_MONTH}-{_DAY}T{_SECONDS}", "yyyy-M-d'T'H:mm:ss"),
        (f"{_YEAR}-{_MONTH}-{_DAY}T{_SECONDS}{_FRACTION}", f"yyyy-M-d'T'H:mm:ss{_DIGITS}"),
        (f"{_YEAR}-{_MONTH}-{_DAY}[T ]{_SECONDS}{_ZONE}", "yyyy-M-d['T'][ ]H:mm:ssXXX"),
        (f"{_YEAR}-{_MONTH}-{_DAY}[T ]{_SECONDS}{_FRACTION}{_ZONE}", f"yyyy-M-d['T'][ ]H:mm:ss{_DIGITS}XXX"),
        (f"{_YEAR}-{_MONTH}-{_DAY} {_HALF_DAY} {_HALF}", "yyyy-M-d h:mm a"),
        (f"{_YEAR}-{_MONTH}-{_DAY} {_HALF_DAY}:[0-5][0-9] {_HALF}", "yyyy-M-d h:mm:ss a"),
        (f"{_YEAR}/{_MONTH}/{_DAY}", "yyyy/M/d"),
        (f"{_YEAR}/{_MONTH}/{_DAY} {_SECONDS}", "yyyy/M/d H:mm:ss"),
        (f"{_MONTH}/{_DAY}/{_YEAR}", "M/d/yyyy"),
        (f"{_DAY}/{_MONTH}/{_YEAR}", "d/M/yyyy"),
        (f"{_MONTH}/{_DAY}/{_YEAR} {_CLOCK}", "M/d/yyyy H:mm"),
        (f"{_DAY}/{_MONTH}/{_YEAR} {_CLOCK}", "d/M/yyyy H:mm"),
        (f"{_MONTH}/{_DAY}/{_YEAR} {_SECONDS}", "M/d/yyyy H:mm:ss"),
        (f"{_DAY}/{_MONTH}/{_YEAR} {_SECONDS}", "d/M/yyyy H:mm:ss"),
        (f"{_MONTH}/{_DAY}/{_YEAR} {_HALF_DAY} {_HALF}", "M/d/yyyy h:mm a"),
        (f"{_DAY}/{_MONTH}/{_YEAR} {_HALF_DAY} {_HALF}", "d/M/yyyy h:mm a"),
        (f"{_MONTH}/{_DAY}/{_YEAR} {_HALF_DAY}:[0-5][0-9] {_HALF}", "M/d/yyyy h:mm:ss a"),
        (f"{_DAY}/{_MONTH}/{_YEAR} {_HALF_DAY}:[0-5][0-9] {_HALF}", "d/M/yyyy h:mm:ss a"),
        (f"{_MONTH}/{_DAY}/{_SHORT_YEAR}", "M/d/yy"),
        (f"{_DAY}/{_MONTH}/{_SHORT_YEAR}", "d/M/yy"),
        (f"{_MONTH}/{_DAY}/{_SHORT_YEAR} {_CLOCK}", "M/d/yy H:mm"),
        (f"{_DAY}/{_MONTH}/{_SHORT_YEAR} {_CLOCK}", "d/M/yy H:mm"),
        (f"{_MONTH}-{_DAY}-{_YEAR}", "M-d-yyyy"),
        (f"{_DAY}-{_MONTH}-{_YEAR}", "d-M-yyyy"),
        (rf"{_MONTH}\.{_DAY}\.{_YEAR}", "M.d.yyyy"),
        (rf"{_DAY}\.{_MONTH}\.{_YEAR}", "d.M.yyyy"),
        (f"{_DAY} [A-Za-z]{{3}} {_YEAR}", "d MMM yyyy"),
        (f"{_DAY}-[A-Za-z]{{3}}-{_YEAR}", "d-MMM-yyyy"),
        (f"[A-Za-z]{{3}} {_DAY}, {_YEAR}", "MMM d, yyyy"),
        (f"{_DAY} [A-Za-z]{{3,9}} {_YEAR}", "d MMMM yyyy"),
        (f"[A-Za-z]{{3,9}} {_DAY}, {_YEAR}", "MMMM d, yyyy"),
        (f"{_YEAR}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])", "yyyyMMdd"),
        (f"{_YEAR}-(0[1-9]|1[0-2])", "yyyy-MM"),
        (_YEAR, "yyyy"),
    )
)


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def strip(c: Column) -> Column:
    """Trim every kind of white space; ``trim`` alone takes plain spaces only."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def looks_integer(c: Column) -> Column:
    return c.rlike(INTEGER_PATTERN)


def looks_float(c: Column) -> Column:
    return c.rlike(FLOAT_PATTERN)


def looks_boolean(c: Column) -> Column:
    return c.isin(*TRUE_TOKENS, *FALSE_TOKENS)


# Longer texts are no date in any layout.
DATE_LENGTH = 40


def date_form(digits: str) -> str:
    """Of a text with 9 for every digit: letters of three and more together as a, so that names of months are alike."""
    return re.sub("(?<=[A-Za-z]{2})[A-Za-z]|(?<=[A-Za-z])[A-Za-z](?=[A-Za-z])|[A-Za-z](?=[A-Za-z]{2})", "a", digits)


def parsed_time(c: Column, shape: str, layout: str) -> Column:
    """Wall-clock time of a text in exactly this shape and layout, else NULL; in UTC where the text names a zone."""
    time = F.try_to_timestamp(c, F.lit(layout))
    if layout.endswith("X"):
        wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp_ntz"))
    else:
        wall = time.cast("timestamp_ntz")
    if re.search("(?<!y)yy(?!y)", layout):
        late = F.year(wall) >= 2000 + FIRST_OF_LAST_CENTURY
        wall = F.when(late, wall - F.make_ym_interval(F.lit(100))).otherwise(wall)
    return F.when(c.rlike(shape), wall)


def two_decimals(c: Column) -> Column:
    """Fixed two decimals, rounded half-even like the texts the report quotes."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")
