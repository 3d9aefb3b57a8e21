"""Workbooks (xlsx, xlsm) as rows of text: a zip of XML, read on the workers without a library of its own."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The names of a workbook's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(content: bytes | BinaryIO) -> list[str]:
    """The names of a workbook's sheets, in order; of an open file only its directory and one small part are read."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]


def made(content: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells: its sheets' rows."""
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    main, link = MAIN.strip("{}"), LINK[1:].split("}")[0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(content, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{link}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(content) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(content.values(), 1):
            cell = lambda n, c, v: f'<c r="{letters(c)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
            body = "".join(f'<row r="{n}">' + "".join(cell(n, c, v) for c, v in enumerate(row) if v) + "</row>" for n, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def letters(column: int) -> str:
    """A column's name, from 0 for A."""
    name = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        name = chr(65 + r) + name
    return name


def lines(content: bytes | BinaryIO, only: str | None = None) -> Iterator[tuple[str, int, str]]:
    """(sheet, row, line) of filled rows, of one sheet if it is named: cells as [A1]value, parted by TABs. Rows are streamed."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        names = set(z.namelist())
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            if only is not None and sheet.get("name") != only:
                continue
            part = "xl/" + targets[sheet.get(LINK)].removeprefix("/xl/")
            n = 0
            with z.open(part) as f:
                data = None
                for event, row in ElementTree.iterparse(f, ("start", "end")):
                    if event == "start" and row.tag == f"{MAIN}sheetData":
                        data = row
                    if event == "start" or row.tag != f"{MAIN}row":
                        continue
                    cells = []
                    for c in row.findall(f"{MAIN}c"):
                        v = c.find(f"{MAIN}v")
                        value = text(c) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                        if value:
                            cells.append(f"[{c.get('r')}]{value}")
                    number = int(row.get("r") or n + 1)
                    row.clear()
                    if data is not None:
                        data.clear()
                    n = number
                    if cells:
                        yield sheet.get("name"), number, "\t".join(cells)


def sheet_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, line, error of the workbooks in a folder, all of their rows. A file that can't be read gives one row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(r"lower(path) rlike '\\.xls[xm]$' and not path rlike '/~[$][^/]*$'").select("path", "content")
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("line", pa.string()), ("error", pa.string())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out: list[tuple] = []
                try:
                    for sheet, row, line in lines(content.as_py()):
                        out.append((p, sheet, row, line, None))
                        if len(out) == 1000:
                            yield table(out)
                            out = []
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
                    out.append((p, None, None, None, re.sub(r"\s+", " ", f"{type(e).__name__}: {e}")))
                if out:
                    yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(rows, "path string, sheet string, row int, line string, error string")
