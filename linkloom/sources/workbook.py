"""Result rows as spreadsheet workbooks: the sink of the report."""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from linkloom.operators.numbering import number_rows

ROWS_PER_BOOK, SHEET = 50_000, "QR Results"
# The sheet's columns, widths and colours (fill, letters).
FILE_COLUMNS = ("Filename", "Filename Date", "Last 4 Digits", "Client ID", "Form Type")
WIDTHS = {"Filename": 42, "Filename Date": 16, "Last 4 Digits": 16, "Client ID": 14, "Form Type": 14, "Page Number": 14, "Source": 12, "QR Code Attachment": 20, "URL": 54, "Status": 36}
PICTURES, GOOD, BAD = "QR Code Attachment", ("C6EFCE", "006100"), ("FFC7CE", "9C0006")
#: Columns that stay in the sheet though rows are ordered by them.
SHOWN = ("Page Number",)
KIND = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _runs(rows: list[tuple], k: int) -> list[tuple[int, int]]:
    """First and last row of each run of equal, non-empty values of a column, of two rows or more."""
    out, start = [], 0
    for n in range(1, len(rows) + 1):
        if n == len(rows) or rows[n][k] != rows[start][k]:
            if n - start > 1 and rows[start][k]:
                out.append((start, n - 1))
            start = n
    return out


def _letter(k: int) -> str:
    return chr(65 + k) if k < 26 else _letter(k // 26 - 1) + chr(65 + k % 26)


def _styles() -> str:
    """Cell styles: 0 plain, 1 text, 2 a working link, 3 a failed one, 4 text of merged cells."""
    font = lambda colour: f'<font><b/><sz val="11"/><color rgb="FF{colour}"/><name val="Calibri"/></font>'
    fill = lambda colour: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{colour}"/></patternFill></fill>'
    plain = '<font><sz val="11"/><name val="Calibri"/></font>'
    cells = ["", 'numFmtId="49" applyNumberFormat="1"', 'fontId="1" fillId="2" applyFont="1" applyFill="1"', 'fontId="2" fillId="3" applyFont="1" applyFill="1"']
    align = '<xf xfId="0" numFmtId="49" applyNumberFormat="1" applyAlignment="1"><alignment horizontal="left" vertical="center"/></xf>'
    fills = f'<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill(GOOD[0])}{fill(BAD[0])}'
    body = f'<fonts count="3">{plain}{font(GOOD[1])}{font(BAD[1])}</fonts><fills count="4">{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    return f'{HEAD}<styleSheet xmlns="{KIND}">{body}<cellXfs count="5">{"".join(f"<xf xfId=\"0\" {c}/>" for c in cells)}{align}</cellXfs></styleSheet>'


def _drawing(pictures: list[tuple[int, int]]) -> str:
    """Pictures (row, number) of 72 by 72 points of a screen, each at its row's cell of the picture column."""
    anchor = (
        '<xdr:oneCellAnchor><xdr:from><xdr:col>{col}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:ext cx="685800" cy="685800"/>'
        '<xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{n}" name="code {n}"/><xdr:cNvPicPr/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="p{n}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill>'
        '<xdr:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="685800" cy="685800"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:oneCellAnchor>'
    )
    kinds = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    return f'{HEAD}<xdr:wsDr {kinds} xmlns:r="{OFFICE}/relationships">{"".join(anchor.format(col=c, row=r, n=n) for n, (r, c) in enumerate(pictures, 1))}</xdr:wsDr>'


def book_bytes(columns: list[str], rows: list[tuple], pictures: list[bytes | None] | None = None) -> bytes:
    """A workbook of one sheet; all cells are text, so that leading zeros stay.

    The columns of a file are merged over its rows, a status is green or red, the header stays in sight and filters the
    rows, and a row's picture stands in the picture column.
    """
    text_of = lambda v: "" if v is None else str(v)
    style, merges = [[1 if c in FILE_COLUMNS else 0 for c in columns] for _ in rows], []
    name, status = (columns.index(c) if c in columns else None for c in ("Filename", "Status"))
    if status is not None:
        for k, r in enumerate(rows):
            style[k][status] = 2 if text_of(r[status]).strip() == "Working" else 3 if text_of(r[status]).strip() else 0
    blank = set()
    for a, b in _runs(rows, name) if name is not None else ():
        for c in (columns.index(x) for x in FILE_COLUMNS if x in columns):
            merges.append(f"{_letter(c)}{a + 2}:{_letter(c)}{b + 2}")
            blank |= {(k, c) for k in range(a + 1, b + 1)}
            style[a][c] = 4
    placed = [(k + 1, columns.index(PICTURES)) for k, p in enumerate(pictures or ()) if p and PICTURES in columns]
    tall = {r for r, _ in placed}
    cell = lambda v, s=0: f'<c s="{s}" t="inlineStr"><is><t xml:space="preserve">{escape(text_of(v))}</t></is></c>'
    lines = ["<row>" + "".join(map(cell, columns)) + "</row>"]
    for k, r in enumerate(rows):
        lines.append(("<row ht=\"58\" customHeight=\"1\">" if k + 1 in tall else "<row>") + "".join(cell("" if (k, c) in blank else v, style[k][c]) for c, v in enumerate(r)) + "</row>")
    widths = "".join(f'<col min="{k}" max="{k}" width="{16 if c == PICTURES and placed else WIDTHS[c]}" customWidth="1"/>' for k, c in enumerate(columns, 1) if c in WIDTHS)
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    after = f'<autoFilter ref="A1:{_letter(len(columns) - 1)}{len(rows) + 1}"/>' + (f'<mergeCells count="{len(merges)}">{"".join(f"<mergeCell ref=\"{m}\"/>" for m in merges)}</mergeCells>' if merges else "") + ('<drawing r:id="d1"/>' if placed else "")
    sheet = f'{HEAD}<worksheet xmlns="{KIND}" xmlns:r="{OFFICE}/relationships">{view}{f"<cols>{widths}</cols>" if widths else ""}<sheetData>{"".join(lines)}</sheetData>{after}</worksheet>'
    types = "application/vnd.openxmlformats-officedocument"
    over = lambda part, kind: f'<Override PartName="/xl/{part}" ContentType="{types}.{kind}+xml"/>'
    related = lambda *x: f'{HEAD}<Relationships xmlns="{LINKS}">{"".join(f"<Relationship Id=\"{i}\" Type=\"{OFFICE}/relationships/{t}\" Target=\"{to}\"/>" for i, t, to in x)}</Relationships>'
    drawn = over("drawings/drawing1.xml", "drawing") if placed else ""
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/>{over("workbook.xml", "spreadsheetml.sheet.main")}{over("worksheets/sheet1.xml", "spreadsheetml.worksheet")}{over("styles.xml", "spreadsheetml.styles")}{drawn}</Types>',
        "_rels/.rels": related(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{KIND}" xmlns:r="{OFFICE}/relationships"><sheets><sheet name="{SHEET}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": related(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "styles", "styles.xml")),
        "xl/styles.xml": _styles(),
        "xl/worksheets/sheet1.xml": sheet,
    }
    if placed:
        held = [p for p in pictures if p]
        parts |= {"xl/worksheets/_rels/sheet1.xml.rels": related(("d1", "drawing", "../drawings/drawing1.xml")), "xl/drawings/drawing1.xml": _drawing(placed)}
        parts["xl/drawings/_rels/drawing1.xml.rels"] = related(*((f"p{n}", "image", f"../media/p{n}.png") for n in range(1, len(held) + 1)))
        parts |= {f"xl/media/p{n}.png": p for n, p in enumerate(held, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, content in parts.items():
            z.writestr(zipfile.ZipInfo(part), content)
    return out.getvalue()


def png_bytes(pixels: np.ndarray, most: int = 200) -> bytes:
    """A picture, grey (height, width) or coloured (height, width, 3), as PNG; a larger one is made smaller by means of whole blocks."""
    if not pixels.size:
        return b""
    n = -(-max(pixels.shape[:2]) // most)
    if n > 1:
        # the last blocks go on with the picture's edge, so no line of it is lost
        pixels = np.pad(pixels, [(0, -pixels.shape[0] % n), (0, -pixels.shape[1] % n), *[(0, 0)] * (pixels.ndim - 2)], mode="edge")
        h, w = pixels.shape[:2]
        pixels = pixels.reshape(h // n, n, w // n, n, *pixels.shape[2:]).mean(axis=(1, 3)).round()
    pixels = pixels.astype(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\x00" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _parts(results: DataFrame, by: str, order: list[str], rows_per_book: int) -> DataFrame:
    """results with __part: rows of a value of by in the order, so many to a part.

    Rows are numbered over ranges of (by, order), and a part is told by the distance from the first row of its value, so
    a value with very many rows is never in one task.
    """
    numbered = number_rows(results, [by, *(c for c in order if c != by)], "__n")
    first = numbered.groupBy(by).agg(F.min("__n").alias("__first")).withColumnRenamed(by, "__by")
    joined = numbered.join(first, F.col(by).eqNullSafe(F.col("__by")))
    return joined.withColumn("__part", F.floor((F.col("__n") - F.col("__first")) / rows_per_book)).drop("__by", "__first")


def workbooks(results: DataFrame, by: str, order: list[str], rows_per_book: int = ROWS_PER_BOOK, picture_col: str | None = None) -> DataFrame:
    """by, part, n_rows, content: a workbook for each value of by, in parts of at most rows_per_book rows; picture_col holds a row's PNG."""
    columns = _columns(results, by, order, picture_col)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", kind="stable")
        return pd.DataFrame({by: [pdf[by].iloc[0]], "part": [int(pdf["__part"].iloc[0])], "n_rows": [len(pdf)], "content": [book_bytes(columns, list(pdf[columns].itertuples(index=False, name=None)), list(pdf[picture_col]) if picture_col else None)]})

    return _parts(results, by, order, rows_per_book).groupBy(by, "__part").applyInPandas(write, f"`{by}` {results.schema[by].dataType.simpleString()}, part int, n_rows int, content binary")


def _columns(results: DataFrame, by: str, order: list[str], picture_col: str | None) -> list[str]:
    return [c for c in results.columns if (c not in order or c in (by, *SHOWN)) and c != picture_col]


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written beside their places: (written, final name)."""

    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceWriter):
    """Each task writes its workbooks into a folder of the job beside their places; the job's commit moves those of the tasks that ended well, its abort removes them all."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.by, self.columns, self.overwrite = options["path"], options["by"], columns, overwrite
        self.shown, self.picture = options["columns"].split("\x1f"), options.get("picture") or None
        self.job = f"_writing-{uuid.uuid4().hex}"

    def _place(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, path = self._place()
        fs.create_dir(f"{path}/{self.job}", recursive=True)
        task, files = TaskContext.get().taskAttemptId(), []
        try:
            for (value, part), rows in groupby(iterator, key=lambda r: (r[self.by], r["__part"])):
                held = list(rows)
                stem = re.sub(r"[^A-Za-z0-9._-]+", "_", str(value if value is not None else "none"))[:100]
                # a digest keeps apart values that have one name once odd characters are gone
                name = f"{stem}-{zlib.crc32(repr(value).encode()):08x}-{part:05}.xlsx"
                at = f"{path}/{self.job}/{task}-{name}"
                with fs.open_output_stream(at) as out:
                    files.append((at, name))
                    out.write(book_bytes(self.shown, [tuple(r[c] for c in self.shown) for r in held], [r[self.picture] for r in held] if self.picture else None))
        except BaseException:
            for at, _ in files:
                fs.delete_file(at)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = self._place()
        fs.create_dir(path, recursive=True)
        own = {name for m in messages if m for _, name in m.files}
        for f in fs.get_file_info(FileSelector(path)) if self.overwrite else []:
            if f.base_name.endswith(".xlsx") and f.base_name not in own:
                fs.delete_file(f.path)
        for at, name in (x for m in messages if m for x in m.files):
            fs.move(at, f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = self._place()
        if fs.get_file_info(f"{path}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{path}/{self.job}")


class WorkbookSource(DataSource):
    """The format `workbook`: rows sorted by a value and __part become a workbook for each; see write_workbooks."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), schema.names, overwrite)


def write_workbooks(results: DataFrame, path: str, by: str, order: list[str], rows_per_book: int = ROWS_PER_BOOK, picture_col: str | None = None, mode: str = "append") -> None:
    """Write a workbook for each value of by and each rows_per_book rows of it into the folder path, which all executors share.

    Files appear when the whole job is done; a job that fails leaves none, and neither does a task that is run again.
    mode is append, where files of equal names are replaced, or overwrite, where other workbooks go. An empty table
    writes none; a null value of by is a file by itself.
    """
    results.sparkSession.dataSource.register(WorkbookSource)
    rows = _parts(results, by, order, rows_per_book).repartition(by, "__part").sortWithinPartitions(by, "__part", "__n")
    options = {"path": path, "by": by, "columns": "\x1f".join(_columns(results, by, order, picture_col)), "picture": picture_col or ""}
    rows.write.format("workbook").options(**options).mode(mode).save()
