"""Spreadsheets (zip archives of XML) as tables of rows, read by Spark's own binary source.

One file is parsed in one task; files are spread over tasks.  Rows are padded to
the widest row of their sheet; empty rows are left out.  Dates stay the numbers
that they are stored as.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.sources.shared import ship

# Name spaces of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELL = re.compile(r"([A-Z]+)[0-9]+")
_ROWS = "path string, sheet string, row long, cells array<string>, error string"


def _column(reference: str, following: int) -> int:
    """The number of a cell's column from a reference such as AB7; cells without one follow each other."""
    m = _CELL.match(reference or "")
    if not m:
        return following
    n = 0
    for letter in m[1]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def grids(content: bytes) -> Iterator[tuple[str, list[tuple[int, list[str]]]]]:
    """(sheet name, [(row number from 1, cells)]) of a workbook in the order of its sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_text(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_LINK)].lstrip("/")
            rows = []
            for k, row in enumerate(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"), 1):
                cells: list[str] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at, value = _column(cell.get("r", ""), len(cells)), cell.find(f"{_MAIN}v")
                    raw = (value.text or "") if value is not None else _text(cell)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = (shared[int(raw)] if cell.get("t") == "s" and raw else raw).strip()
                rows.append((int(row.get("r", k)), cells))
            width = max((len(c) for _, c in rows), default=0)
            yield sheet.get("name", ""), [(k, c + [""] * (width - len(c))) for k, c in rows if any(c)]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out: list[tuple] = []
            try:
                out = [(path, name, k, cells, None) for name, rows in grids(content.as_buffer().to_pybytes()) for k, cells in rows]
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:  # a broken file is a row that says so
                out = [(path, None, None, None, f"{type(e).__name__}: {e}")]
            if out:
                types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["path", "sheet", "row", "cells", "error"])


def read_workbooks(spark: SparkSession, paths: str | list[str], sheet: str | None = None, most_rows: int | None = 50_000) -> DataFrame:
    """(path, sheet, row, cells, error) of the workbooks at ``paths``.

    ``sheet``: of one sheet only, by name.  ``most_rows``: as many filled rows of
    a sheet at most, the first ones; None for all.  A file that is no workbook
    gives one row with an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = files.mapInArrow(_parsed, _ROWS)
    if sheet is not None:
        rows = rows.where((F.col("sheet") == sheet) | F.col("error").isNotNull())
    if most_rows is None:
        return rows
    at = F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row"))
    return rows.withColumn("at", at).where(F.col("at") <= most_rows).drop("at")


def compact_text(rows: DataFrame) -> DataFrame:
    """(path, sheet, text): the sheet as tab-separated lines without the columns that are empty in all rows."""
    cells = rows.where("error IS NULL").select("path", "sheet", "row", F.posexplode("cells").alias("at", "cell"))
    used = cells.where("cell <> ''").select("path", "sheet", "at").distinct()
    lines = cells.join(used, ["path", "sheet", "at"]).groupBy("path", "sheet", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "cell"))), lambda x: x["cell"]), "\t").alias("line"))
    return lines.groupBy("path", "sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))
