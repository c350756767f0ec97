"""Spreadsheets to rows: the first sheet of each XLSX file, as arrays of cell texts.

A workbook is a zip of XML parts, which Spark has no reader for; files are read as bytes and opened in Arrow batches, each in
one task. What a sheet's columns mean is decided afterwards, with columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    """The number of a cell's column, from 0: A1 is 0, AA7 is 26."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def cells(data: bytes | None) -> list[list[str | None]]:
    """The rows of a workbook's first sheet; empty cells are null, rows end with their last filled cell. What is no workbook
    has none."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data or b""))
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        sheet = ElementTree.fromstring(book.read(names[0]))
        shared = ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in book.namelist() else ()
    except (zipfile.BadZipFile, IndexError, KeyError, ElementTree.ParseError):
        return []
    texts = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in shared]
    out = []
    for row in sheet.iter(f"{_MAIN}row"):
        found: list[str | None] = []
        for cell in row.iter(f"{_MAIN}c"):
            at = _column(cell.get("r", ""))
            at = at if at >= 0 else len(found)
            found += [None] * (at + 1 - len(found))
            value = cell.find(f"{_MAIN}v")
            if cell.get("t") == "inlineStr":
                found[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif value is not None and value.text is not None:
                found[at] = texts[int(value.text)] if cell.get("t") == "s" else value.text
        while found and found[-1] is None:
            found.pop()
        out.append(found)
    return out


def sheet_rows(files: DataFrame) -> DataFrame:
    """files (path, content) to path, row (from 0) and cells, array<string>; broken and null content has no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = cells(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["path", "row", "cells"])

    return files.select("path", "content").mapInArrow(read, "path string, row int, cells array<string>")


def headed(rows: DataFrame, columns: tuple[str, ...], lower: bool = True) -> DataFrame:
    """Rows below each file's first, with the named columns found by that header row (trimmed, of any case); null where a file has
    no such column, and without rows that are empty in all of them."""
    name = lambda x: F.lower(F.trim(x)) if lower else F.trim(x)
    head = rows.where("row = 0").select("path", F.transform("cells", name).alias("head"))
    met = rows.where("row > 0").join(head, "path")
    place = lambda c: F.array_position("head", c.lower() if lower else c)
    out = met.select("path", "row", *[F.when(place(c) > 0, F.nullif(F.trim(F.get("cells", (place(c) - 1).cast("int"))), F.lit(""))).alias(c) for c in columns])
    return out.where(F.coalesce(*columns).isNotNull())
