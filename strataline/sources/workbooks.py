"""Workbooks: sheets, their cells and their used ranges, from the packaged XML of a file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CELL = re.compile(r"([A-Z]+)([0-9]+)")
CELLS = "path string, sheet string, row_no int, column string, value string, formula string"
SHEETS = "path string, position int, sheet string, tables int"


class Workbook:
    def __init__(self, data: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.archive.namelist())
        book = self._xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target", "") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = [(s.get("name", ""), "xl/" + targets[s.get(f"{_REL}id")].removeprefix("/xl/")) for s in book.iter(f"{_MAIN}sheet")]
        self.strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.names else []

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.archive.read(name))

    def tables(self, file: str) -> int:
        rels = file.replace("worksheets/", "worksheets/_rels/") + ".rels"
        return sum("table" in r.get("Type", "").rsplit("/", 1)[-1] for r in self._xml(rels)) if rels in self.names else 0

    def cells(self, file: str) -> Iterator[tuple[int, str, str | None, str | None]]:
        """(row, column letters, value, formula) of the used cells, in order."""
        for c in self._xml(file).iter(f"{_MAIN}c"):
            m = _CELL.fullmatch(c.get("r", ""))
            if not m:
                continue
            raw, kind = c.findtext(f"{_MAIN}v"), c.get("t")
            if kind == "s" and raw is not None:
                raw = self.strings[int(raw)]
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif kind == "b" and raw is not None:
                raw = "TRUE" if raw == "1" else "FALSE"
            formula = c.findtext(f"{_MAIN}f")
            if raw is not None or formula is not None:
                yield int(m.group(2)), m.group(1), raw, None if formula is None else "=" + formula


def sheets(files: DataFrame) -> DataFrame:
    """``(path, position, sheet, tables)`` of the workbooks ``(path, data)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                book = Workbook(data)
                rows += [(path, k, name, book.tables(file)) for k, (name, file) in enumerate(book.sheets)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32()))], names=["path", "position", "sheet", "tables"])

    return files.select("path", "data").mapInArrow(run, SHEETS)


def cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Used cells of the workbooks ``(path, data)``, of one sheet or all, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                book = Workbook(data)
                for name, file in book.sheets:
                    if sheet is None or name == sheet:
                        rows = [(path, name, *c) for c in book.cells(file)]
                        cols = list(zip(*rows)) or [()] * 6
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "sheet", "row_no", "column", "value", "formula"])

    return files.select("path", "data").mapInArrow(run, CELLS)


def grid(used: DataFrame, columns: list[str]) -> DataFrame:
    """One row per sheet row with the named columns, for queries over a range."""
    from pyspark.sql import functions as F

    picked = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    return used.groupBy("path", "sheet", "row_no").agg(*picked)
