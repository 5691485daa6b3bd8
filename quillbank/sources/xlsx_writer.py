"""Export rows as workbooks: built inside executors, saved without ever replacing a file."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbank.sources.committed_files import file_list, save_files

SHEET = "题库"
ROWS_EACH = 20_000
#: Namespaces, content types and part names that the format prescribes, here and in Workbook.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_SHAPE = "book long, n_rows long, content_sha256 string, content binary"
_ARROW = pa.schema([("book", pa.int64()), ("n_rows", pa.int64()), ("content_sha256", pa.string()), ("content", pa.binary())])


def column_label(number: int) -> str:
    """Letters of a worksheet column, counted from 1."""
    letters = ""
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


class Workbook:
    """A workbook of one sheet that grows by rows; only what is compressed stays in memory."""

    def __init__(self, headings: list[str], sheet: str = SHEET):
        self.buffer, self.n, self.width = io.BytesIO(), 0, len(headings)
        self.archive = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_DEFLATED)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        }
        for name, body in parts.items():
            self._part(name, _HEAD + body)
        self.sheet = self.archive.open(self._entry("xl/worksheets/sheet1.xml"), "w", force_zip64=True)
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.add(headings)

    @staticmethod
    def _entry(name: str) -> zipfile.ZipInfo:
        entry = zipfile.ZipInfo(name)  # a fixed date, so that equal rows give equal files
        entry.compress_type = zipfile.ZIP_DEFLATED
        return entry

    def _part(self, name: str, body: str) -> None:
        self.archive.writestr(self._entry(name), body)

    def add(self, cells: list[str]) -> None:
        self.n += 1
        body = "".join(f'<c r="{column_label(i)}{self.n}" t="inlineStr"><is><t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</t></is></c>' for i, x in enumerate(cells, 1))
        self.sheet.write(f'<row r="{self.n}">{body}</row>'.encode())

    def close(self) -> bytes:
        self.sheet.write(f'</sheetData><autoFilter ref="A1:{column_label(self.width)}{self.n}"/></worksheet>'.encode())
        self.sheet.close()
        self.archive.close()
        return self.buffer.getvalue()


def workbooks(rows: DataFrame, headings: dict[str, str], number: str = "row_number", rows_each: int = ROWS_EACH) -> DataFrame:
    """(book, n_rows, content_sha256, content): `rows` in order of `number` (from 1), at most rows_each to a workbook.

    headings gives columns and what stands above them; nulls are blank cells. Only the rows of one book meet in a task,
    one after another. No rows, no books.
    """
    names = list(headings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(book: int, open_book: Workbook) -> pa.RecordBatch:
            data = open_book.close()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([book], [open_book.n - 1], [hashlib.sha256(data).hexdigest()], [data]), _ARROW, strict=True)], schema=_ARROW)

        at, current = None, None
        for batch in batches:
            for book, *cells in zip(*(batch.column(x).to_pylist() for x in ["__book", *names]), strict=True):
                if book != at:
                    if current is not None:
                        yield done(at, current)
                    at, current = book, Workbook(list(headings.values()))
                current.add(["" if x is None else x for x in cells])
        if current is not None:
            yield done(at, current)

    dealt = rows.select(F.floor((F.col(number) - 1) / rows_each).alias("__book"), F.col(number).cast("long").alias("__at"), *(F.col(x).cast("string").alias(x) for x in names))
    return dealt.repartition("__book").sortWithinPartitions("__book", "__at").mapInArrow(run, _SHAPE)


def save_workbooks(books: DataFrame, folder: str, stem: str = "bank") -> list[str]:
    """Writes each book to a folder that must not exist yet, all or none, from the tasks; returns the paths."""
    named = books.select(F.format_string(f"{stem}-%05d.xlsx", "book").alias("name"), "content")
    save_files(named, folder, allow_none=True)
    return sorted(f"{folder.rstrip('/')}/{r['name']}" for r in file_list(books.sparkSession, folder).select("name").collect())
