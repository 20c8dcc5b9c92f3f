"""Spreadsheets (XLSX) as rows: every file is read by one task, cells travel as text and are typed by Spark."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers

# Numbers of the built-in formats that show a day, and the day from which days count.
DAY_FORMATS = {*range(14, 23), *range(45, 48)}
DAY_ZERO = datetime(1899, 12, 30)


def rows(spark: SparkSession, path: str, sheet: str, first_row: int = 3) -> DataFrame:
    """path, row, cells (map of the first row's names to text): the sheet's rows from first_row on, those without any cell left out.

    Names repeated count once, the last column of each. Days come as yyyy-mm-dd, other numbers as written. A file that isn't a
    workbook, or has no such sheet, is an error that names it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                found = [(file, n, cells) for n, cells in _named_rows(file, content, sheet, first_row)]
                yield pd.DataFrame(found, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, row int, cells map<string, string>")


def records(cells: DataFrame, key: str, numeric: list[str], days: list[str], reviewed: list[str], rest: list[str]) -> DataFrame:
    """key, the numeric (double), day (date) and other (text) columns, missing, wrong and repeated: rows without a key go.

    Numbers and days are strict: what is written otherwise is null and named in wrong. missing names reviewed columns that are
    empty; a column nobody reviewed is never missing. repeated: the key stands in several rows; all of them stay.
    """
    cell = lambda c: F.nullif(F.trim(F.col("cells")[c]), F.lit(""))
    typed = {c: numbers.strict_number(cell(c)) for c in numeric} | {c: numbers.strict_date(cell(c)) for c in days} | {c: cell(c) for c in rest}
    names = lambda conditions: F.array_compact(F.array(*[F.when(w, F.lit(c)) for c, w in conditions.items()]).cast("array<string>"))
    out = cells.select(
        cell(key).alias(key), *[v.alias(c) for c, v in typed.items()], names({c: cell(c).isNull() for c in reviewed}).alias("missing"),
        names({c: cell(c).isNotNull() & typed[c].isNull() for c in [*numeric, *days]}).alias("wrong"),
    ).where(F.col(key).isNotNull())
    counts = out.groupBy(F.col(key).alias("_key")).agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return out.join(counts, F.col(key) == F.col("_key")).drop("_key")


def _xml(book: zipfile.ZipFile, name: str) -> ElementTree.Element:
    """A part of the workbook without namespaces."""
    root = ElementTree.fromstring(book.read(name))
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
        e.attrib = {k.rpartition("}")[2]: v for k, v in e.attrib.items()}
    return root


def _named_rows(file: str, content: bytes, sheet: str, first_row: int) -> Iterator[tuple[int, dict[str, str]]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    parts = set(book.namelist())
    ids = {s.get("name"): s.attrib["id"] for s in _xml(book, "xl/workbook.xml").iter("sheet")}
    if sheet not in ids:
        raise ValueError(f"{file} has no sheet {sheet}: {', '.join(map(str, ids))}")
    targets = {r.get("Id"): r.get("Target", "") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    target = targets[ids[sheet]]
    shared = ["".join(t.text or "" for t in s.iter("t")) for s in _xml(book, "xl/sharedStrings.xml").iter("si")] if "xl/sharedStrings.xml" in parts else []
    as_day = _day_styles(_xml(book, "xl/styles.xml")) if "xl/styles.xml" in parts else []
    names: dict[str, str] = {}
    for row in _xml(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter("row"):
        cells = {re.match("[A-Z]+", c.attrib["r"])[0]: _text(c, shared, as_day) for c in row.iter("c")}
        number = int(row.attrib["r"])
        if number == 1:
            names = {column: name for column, name in cells.items() if name}
        elif number >= first_row and any(cells.values()):
            yield number, {names[k]: v for k, v in cells.items() if k in names and v is not None}


def _day_styles(styles: ElementTree.Element) -> list[bool]:
    own = {int(f.attrib["numFmtId"]): bool(re.search("[dmy]", re.sub(r'"[^"]*"|\[[^]]*\]', "", f.get("formatCode", "").lower()))) for f in styles.iter("numFmt")}
    held = styles.find("cellXfs")
    return [own.get(n := int(x.get("numFmtId", 0)), n in DAY_FORMATS) for x in (held if held is not None else [])]


def _text(cell: ElementTree.Element, shared: list[str], as_day: list[bool]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext("v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter("t"))
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    style = int(cell.get("s", 0))
    if kind == "n" and style < len(as_day) and as_day[style]:
        return (DAY_ZERO + timedelta(days=float(value))).date().isoformat()
    return value
