"""Rows of spreadsheet workbooks, and the blocks of census tables in them."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


_REFERENCE = re.compile(r"([A-Z]+)([1-9][0-9]*)$")


def place(reference: str) -> tuple[int, int]:
    """Row and column from 0 of a cell like 'AB12': letters are digits of base 26 without a zero."""
    found = _REFERENCE.match(reference)
    if not found:
        raise ValueError(f"no cell reference: {reference!r}")
    letters, row = found.groups()
    ahead = sum(26**k for k in range(1, len(letters)))  # shorter names come first
    return int(row) - 1, ahead + int("".join(_DIGITS[c] for c in letters), 26)


_DIGITS = {chr(65 + k): "0123456789abcdefghijklmnop"[k] for k in range(26)}


def _texts(archive: zipfile.ZipFile) -> list[str]:
    """The workbook's table of shared texts, read as a stream."""
    name = "xl/sharedStrings.xml"
    if name not in archive.namelist():
        return []
    with archive.open(name) as f:
        out = []
        for _, e in ET.iterparse(f):
            if e.tag == f"{_NS}si":
                out.append("".join(e.itertext()))
                e.clear()
        return out


def _sheets(archive: zipfile.ZipFile) -> list[str]:
    """Paths of the sheets in the workbook's own order; by name where it does not tell."""
    found = [n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
    try:
        links = {e.get("Id"): e.get("Target") for e in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        sheets = ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{_NS}sheet")
    except KeyError:
        return sorted(found)
    told = ["xl/" + links.get(e.get(_LINK), "").removeprefix("/xl/") for e in sheets]
    return [n for n in told if n in found] + sorted(set(found) - set(told))


def cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the cells of a workbook that hold something; rows and columns from 0."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = _texts(archive)
        for name in _sheets(archive):
            sheet = name.rpartition("/")[2].removesuffix(".xml")
            with archive.open(name) as f:
                for _, e in ET.iterparse(f):
                    if e.tag == f"{_NS}c":
                        text = _content(e, shared)
                        if text is not None:
                            yield sheet, *place(e.get("r")), text
                        e.clear()


def _content(cell: ET.Element, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(cell.itertext())
    value = cell.findtext(f"{_NS}v")
    return shared[int(value)] if value is not None and cell.get("t") == "s" else value


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, text) of workbooks, a task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                got = list(zip(*cells(data.as_py()))) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(got[0]), pa.string()), pa.array(got[0], pa.string()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.int32()), pa.array(got[3], pa.string())],
                    names=["path", "sheet", "row", "col", "text"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row int, col int, text string")


def number(text: Column) -> Column:
    """A whole number of a census cell: a dash or nothing is 0, anything else that is none is null."""
    t = F.regexp_replace(F.trim(text), r"[\s ]", "")
    v = t.try_cast("double")
    return F.when(t.isNull() | t.isin("", "-", "–", "—"), 0).when(v == F.floor(v), v).cast("long")


def blocks(sheet: DataFrame, titles: list[str]) -> DataFrame:
    """Rows of a sheet with the title above them: the last first-column text that begins with one of ``titles``."""
    t = F.lower(F.trim("text"))
    begins = F.lit(False)
    for x in titles:
        begins = begins | t.startswith(x.lower())
    w = W.Window.partitionBy("path", "sheet").orderBy("row", "col")
    title = F.last(F.when((F.col("col") == 0) & begins, F.trim("text")), ignorenulls=True).over(w)
    return sheet.withColumn("block", title).where(F.col("block").isNotNull())
