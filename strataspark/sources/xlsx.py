"""XLSX workbooks by zipfile and XML alone: a source of rows and a sink whose tasks make one workbook each."""

from __future__ import annotations

import gzip
import io
import itertools
import math
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folder import write_files

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>%s</Types>"""
_RELS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>"""
_STYLES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>"""
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


#: Rows that a task reads from a workbook at once.
ROWS = 10_000


def _column(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value, style: str = "") -> str:
    """Missing and non-finite numbers are blank."""
    if value is None or isinstance(value, float) and not math.isfinite(value) or value is pd.NaT:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}"{style} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{style}><v>{value!r}</v></c>'
    return f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


class _Book:
    """A workbook that is written row by row: what is held is its compressed bytes; a sheet's rows wait in a temporary file for the widths of its columns."""

    def __init__(self):
        self.out, self.names = io.BytesIO(), []
        self.z = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)

    def sheet(self, name: str, header: list[str], rows: Iterable[list]) -> None:
        self.names.append(name[:31])
        width, y, size = [0] * len(header), 0, 0
        with tempfile.TemporaryFile() as kept:
            with gzip.GzipFile(fileobj=kept, mode="wb", compresslevel=1) as body:
                for y, r in enumerate(itertools.chain([header], rows), 1):
                    width = [max(w, len(str(v))) for w, v in zip(width, r, strict=True)]
                    size += body.write((f'<row r="{y}">' + "".join(_cell(f"{_column(x)}{y}", v, ' s="1"' if y == 1 else "") for x, v in enumerate(r)) + "</row>").encode())
            cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{min(40, w + 2)}" customWidth="1"/>' for i, w in enumerate(width))
            last = f"{_column(max(0, len(header) - 1))}{y}"
            kept.seek(0)
            with self.z.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=size > 1 << 30) as f, gzip.GzipFile(fileobj=kept, mode="rb") as body:
                f.write((f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_NS["m"]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' + (f"<cols>{cols}</cols>" if cols else "") + "<sheetData>").encode())
                shutil.copyfileobj(body, f, 1 << 20)
                f.write(f'</sheetData><autoFilter ref="A1:{last}"/></worksheet>'.encode())

    def done(self) -> bytes:
        n = len(self.names)
        with self.z as z:
            z.writestr("[Content_Types].xml", _TYPES % "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, n + 1)))
            z.writestr("_rels/.rels", _RELS % f'<Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/>')
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(self.names, 1)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", _RELS % ("".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{_REL}/styles" Target="styles.xml"/>'))
            z.writestr("xl/styles.xml", _STYLES)
        return self.out.getvalue()


def workbook(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A workbook with a sheet for each table: bold header, frozen, with filters, columns as wide as their text (at most 40)."""
    if not sheets:
        raise ValueError("a workbook needs a sheet")
    book = _Book()
    for name, df in sheets.items():
        book.sheet(name, [str(c) for c in df.columns], ([getattr(v, "item", lambda v=v: v)() for v in r] for r in df.itertuples(index=False)))
    return book.done()


def rows_of(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, 1-based row, cells as text) of a workbook; blank cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in book.find("m:sheets", _NS):
            target = targets[sheet.get(f"{{{_REL}}}id")].lstrip("/")
            parsed = ElementTree.iterparse(z.open(target if target.startswith("xl/") else f"xl/{target}"), events=("start", "end"))
            rows = None
            for event, row in parsed:
                if event == "start":
                    rows = row if row.tag == f"{{{_NS['m']}}}sheetData" else rows
                    continue
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: list[str | None] = []
                for c in row:
                    letters = re.match("[A-Z]+", c.get("r"))[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (at - len(cells))
                    value = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None:
                        cells[at - 1] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield sheet.get("name"), int(row.get("r")), cells
                # rows that were told are not kept
                rows.clear()


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of all workbooks under a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for some in itertools.batched(rows_of(content), ROWS):
                    yield pd.DataFrame([(name, *r) for r in some], columns=["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def _as_cells(df: DataFrame) -> Column:
    """All columns of a row as (kind, text): n for numbers, b for booleans, s for the rest; missing values stay null."""
    kind = lambda t: "b" if t == "boolean" else "n" if re.match("tinyint|smallint|int|bigint|float|double|decimal", t) else "s"
    return F.array(*(F.struct(F.lit(kind(t)).alias("kind"), F.col(f"`{c}`").cast("string").alias("text")) for c, t in df.dtypes))


def _value(kind: str, text: str | None):
    if text is None or kind == "s":
        return text
    if kind == "b":
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text)


def workbooks(sheets: dict[str, tuple[DataFrame, list[str]]], book: str) -> DataFrame:
    """(book, content): a workbook for each value of the column `book`, with the sheets (rows and the columns that order them) in order.

    A sheet shows all columns but `book`; one without rows for a book has its header alone. One task makes one workbook, row by row from sorted
    rows, so it holds the compressed bytes only. Spreadsheet programs read at most 2^20 rows of a sheet; longer ones are written whole.
    """
    if not sheets:
        raise ValueError("a workbook needs a sheet")
    rows = None
    headers = F.array(*(F.struct(F.lit(k).alias("sheet"), F.lit(name).alias("name"), F.array(*(F.lit(c) for c in df.columns if c != book)).cast("array<string>").alias("header")) for k, (name, (df, _)) in enumerate(sheets.items())))
    for k, (name, (df, order)) in enumerate(sheets.items()):
        shown = df.drop(book)
        place = F.row_number().over(Window.partitionBy(book).orderBy(*order)) if order else F.lit(1)
        part = df.select(F.col(book).cast("string").alias("book"), F.lit(k).alias("sheet"), F.lit(name).alias("name"), F.lit(None).cast("array<string>").alias("header"), place.alias("row"), _as_cells(shown).alias("cells"))
        rows = part if rows is None else rows.unionByName(part)

    # row 0 of each sheet of a book: its header
    heads = rows.select("book").distinct().select("book", F.explode(headers).alias("h")).select("book", "h.sheet", "h.name", "h.header", F.lit(0).alias("row"), F.lit(None).cast(dict(rows.dtypes)["cells"]).alias("cells"))
    rows = rows.unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("book", "sheet", "name", "header", "cells")
        told = itertools.chain.from_iterable(zip(*(batch.column(c).to_pylist() for c in columns), strict=True) for batch in batches)
        for name, own in itertools.groupby(told, lambda r: r[0]):
            made = _Book()
            for _, rows in itertools.groupby(own, lambda r: r[1]):
                head = next(rows)
                made.sheet(head[2], head[3], ([_value(c["kind"], c["text"]) for c in r[4]] for r in rows))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([made.done()], pa.binary())], ["book", "content"])

    return rows.repartition("book").sortWithinPartitions("book", "sheet", "row").mapInArrow(run, "book string, content binary")


def write_report(path: str, sheets: dict[str, DataFrame | tuple[DataFrame, list[str]]]) -> None:
    """Tables as one workbook, made and written by a task; its folder, which must be shared, is made.

    A sheet is a table, or a table and the columns that order it.
    """
    if not path.endswith(".xlsx"):
        raise ValueError("the name must end in .xlsx")
    folder, _, name = path.rpartition("/")
    placed = {k: v if isinstance(v, tuple) else (v, v.columns) for k, v in sheets.items()}
    headed = {k: (df.withColumn("book_", F.lit(name)), order) for k, (df, order) in placed.items()}
    write_files(workbooks(headed, "book_"), folder or ".", "book", "content", into_used=True)
