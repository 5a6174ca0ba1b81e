"""Excel workbooks as a Python data source: the first sheet, from the archive's XML, without other libraries.

A sheet is one XML stream in one archive, so one task reads it; rows are parsed as they come and are not held.
The first row names the columns; types come from a first pass over the cells.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

# XML names of the format, and the numbers of its built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = datetime.datetime(1899, 12, 30)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook:
    """The first sheet of a workbook, row by row."""

    def __init__(self, path: str):
        self.archive = zipfile.ZipFile(path)
        self.shared = self._shared()
        self.dates = self._dates()
        self.sheet = self._first_sheet()

    def _xml(self, name: str):
        return ElementTree.fromstring(self.archive.read(name)) if name in self.archive.namelist() else None

    def _shared(self) -> list[str]:
        root = self._xml("xl/sharedStrings.xml")
        return [] if root is None else ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in root.iter(MAIN + "si")]

    def _dates(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        root = self._xml("xl/styles.xml")
        if root is None:
            return set()
        own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(MAIN + "numFmt")}
        shows = lambda k: k in DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "").lower())))
        cells = root.find(MAIN + "cellXfs")
        return set() if cells is None else {n for n, x in enumerate(cells) if shows(int(x.get("numFmtId", 0)))}

    def _first_sheet(self) -> str:
        book, links = self._xml("xl/workbook.xml"), self._xml("xl/_rels/workbook.xml.rels")
        if book is not None and links is not None:
            sheet = next(book.iter(MAIN + "sheet"), None)
            target = next((x.get("Target") for x in links if sheet is not None and x.get("Id") == sheet.get(RELATION)), None)
            if target:
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        return "xl/worksheets/sheet1.xml"

    def _value(self, cell):
        kind, text = cell.get("t", "n"), cell.findtext(MAIN + "v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(MAIN + "t"))
        if text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(text)]
        if kind == "b":
            return text == "1"
        if kind in ("str", "d"):
            return text
        number = float(text)
        if int(cell.get("s", 0)) in self.dates:
            return EPOCH + datetime.timedelta(seconds=round(number * 86400))
        return int(number) if number.is_integer() and "." not in text and "e" not in text.lower() else number

    def rows(self) -> Iterator[list]:
        with self.archive.open(self.sheet) as f:
            for _, x in ElementTree.iterparse(f):
                if x.tag == MAIN + "row":
                    out: list = []
                    for n, cell in enumerate(x.iter(MAIN + "c")):
                        at = _column(cell.get("r")) if cell.get("r") else n
                        out += [None] * (at - len(out))
                        out.append(self._value(cell))
                    yield out
                    x.clear()


def _type(kinds: set[type], gaps: bool):
    if kinds <= {int}:
        return DoubleType() if gaps or not kinds else LongType()
    if kinds <= {int, float}:
        return DoubleType()
    if kinds == {bool}:
        return StringType() if gaps else BooleanType()
    return TimestampNTZType() if kinds == {datetime.datetime} else StringType()


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.fields = path, [f.dataType for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = Workbook(self.path).rows()
        next(rows, None)
        for row in rows:
            if any(v is not None for v in row):
                yield tuple(self._cast(row[k] if k < len(row) else None, t) for k, t in enumerate(self.fields))

    @staticmethod
    def _cast(v, t):
        if v is None:
            return None
        if isinstance(t, DoubleType):
            return float(v)
        return str(v) if isinstance(t, StringType) else v


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        rows = Workbook(self.options["path"]).rows()
        names = [str(x) if x is not None else f"Unnamed: {k}" for k, x in enumerate(next(rows, []))]
        kinds: list[set] = [set() for _ in names]
        gaps = [False] * len(names)
        for row in rows:
            if any(v is not None for v in row):
                for k in range(len(names)):
                    v = row[k] if k < len(row) else None
                    if v is None:
                        gaps[k] = True
                    else:
                        kinds[k].add(type(v))
        return StructType([StructField(n, _type(k, g)) for n, k, g in zip(names, kinds, gaps, strict=True)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], schema)
