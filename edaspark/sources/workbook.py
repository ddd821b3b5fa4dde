"""Folders of ``.xlsx`` workbooks, one task per workbook.

The first sheet of each is read, its first row being the header. Cells arrive as texts
and then take types like CSV columns do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .scan import header_names, infer_types, normalise_na

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Number formats of the workbook standard that show a date or time.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
ROWS_PER_BATCH = 10_000


def load_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks under a path or pattern; they must share one header."""
    files = spark.read.format("binaryFile").load(path)
    headers = files.select("content").mapInPandas(_headers, "header array<string>").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("Excel Error: " + ("workbooks differ in their header" if headers else "no workbook found"))
    names = header_names(headers[0]["header"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from _batches(sheet_rows(content), names)

    texts = files.select("content").repartition("content").mapInPandas(decode, schema)
    return infer_types(normalise_na(texts))


def _headers(batches):
    for batch in batches:
        yield pd.DataFrame({"header": [next(sheet_rows(content), []) for content in batch["content"]]})


def _batches(rows, names):
    next(rows, None)
    held = []
    for row in rows:
        if any(cell is not None for cell in row):
            held.append((row + [None] * len(names))[: len(names)])
        if len(held) == ROWS_PER_BATCH:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts, gaps as None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _shared_strings(book)
        dates, epoch = _date_styles(book), _epoch(book)
        with book.open(_first_sheet(book)) as sheet:
            at = 0
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", at + 1))
                for _gap in range(number - at - 1):
                    yield []
                at = number
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    place = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place - len(cells))
                    cells.append(_text(cell, strings, dates, epoch))
                yield cells
                row.clear()


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _text(cell, strings, dates, epoch):
    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None:
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "e":
        return value
    if kind in (None, "n") and int(cell.get("s", 0)) in dates:
        moment = epoch + timedelta(seconds=round(float(value) * 86400, 3))
        return moment.isoformat(sep=" ")
    if kind in (None, "n") and float(value).is_integer():
        return str(int(float(value)))
    return value


def _shared_strings(book):
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]


def _date_styles(book):
    """Indices of cell styles that show numbers as dates."""
    if "xl/styles.xml" not in book.namelist():
        return frozenset()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = set()
    for fmt in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", "")).lower()
        if re.search("[ymdhs]", code):
            custom.add(int(fmt.get("numFmtId")))
    styles = root.find(f"{MAIN}cellXfs")
    shown = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return frozenset(i for i, f in enumerate(shown) if f in DATE_FORMATS or f in custom)


def _epoch(book):
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    properties = root.find(f"{MAIN}workbookPr")
    return EPOCH_1904 if properties is not None and properties.get("date1904") in ("1", "true") else EPOCH


def _first_sheet(book):
    """Path of the first listed sheet, by the workbook's relations."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    first = next(root.iter(f"{MAIN}sheet"))
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == first.get(link):
            target = relation.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook lists no sheet")
