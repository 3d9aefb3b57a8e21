"""`spark.read.format("shelf")`: a folder of files of several kinds as rows of lines; `spark.readStream` of the same for inboxes.

A partition is a file, or a sheet of a workbook, so a large workbook is as many tasks as it has sheets. What a file is follows from its
extension: plain text (txt, md, csv, tsv, html) in lines, workbooks (xlsx, xlsm) in filled rows. Kinds that need another program (pdf, doc, images)
and files that can't be read give one row with `error` in place of lines, so nothing of a folder is missing without a trace; temporary
files (`~$`) and extensions that a shelf doesn't take are left out. The options ext and kind choose files before any is opened; filters are not pushed
into the source, as scans of one DataFrame with different filters would share what the last one pushed.

The stream's offset is the latest modification time and the files that have it: a file is read once, when it is there with its final name. Several folders, parted
by commas in `path`, are one stream.

Files are reached through pyarrow's file systems (local paths, file:, hdfs:, s3:), on the driver to plan and on executors to read. A store that only
Spark reaches goes through tessel.sources.files instead.

Options: path; ext and kind (values parted by commas); encoding (default: by mark, then UTF-8, then Shift-JIS where that loses less).
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessel.sources import workbook

#: Extensions that a shelf takes.
PLAIN, BOOKS, OTHERS = ("txt", "md", "csv", "tsv", "html"), ("xlsx", "xlsm"), ("pdf", "doc", "docx", "xls", "png", "jpg", "jpeg")
KINDS = {**dict.fromkeys(PLAIN, "text"), **dict.fromkeys(BOOKS, "workbook"), **dict.fromkeys(OTHERS, "other")}
REPLACED = 0.02
SMALL = 1 << 16
BATCH = 2000
SCHEMA = "path string, name string, ext string, kind string, unit string, row int, line string, error string, modified_at timestamp"
ARROW = pa.schema([*((n, pa.string()) for n in ("path", "name", "ext", "kind", "unit")), ("row", pa.int32()), ("line", pa.string()), ("error", pa.string()), ("modified_at", pa.timestamp("us", tz="UTC"))])


@dataclass
class File(InputPartition):
    root: str
    path: str
    at: int  # nanoseconds
    unit: str | None = None
    error: str | None = None

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def ext(self) -> str:
        return self.name.rsplit(".", 1)[-1].lower() if "." in self.name else ""

    @property
    def kind(self) -> str:
        return KINDS.get(self.ext, "")


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]*:", root) else (pafs.LocalFileSystem(), root)


def listed(roots: str) -> list[File]:
    """The shelf's files in folders parted by commas, by path."""
    found = []
    for root in (r.strip() for r in roots.split(",")):
        held, top = opened(root)
        for f in held.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)):
            at = File(root, f.path, f.mtime_ns or 0)
            if f.is_file and at.kind and not at.name.startswith(("~$", ".")):
                found.append(at)
    return sorted(found, key=lambda f: (f.at, f.path))


def content(f: File) -> bytes:
    with opened(f.root)[0].open_input_stream(f.path) as s:
        return s.read()


def book(f: File) -> BinaryIO:
    """A workbook as a file to seek in: read whole where it is small (no place before a short file's beginning is asked for), else left where it is."""
    held = opened(f.root)[0]
    return held.open_input_file(f.path) if (held.get_file_info(f.path).size or 0) > SMALL else io.BytesIO(content(f))


def decoded(b: bytes, encoding: str | None = None) -> str:
    """Text of bytes: by the given charset or their mark, else UTF-8, unless that leaves many replacement characters and Shift-JIS fewer."""
    if encoding:
        return b.decode(encoding, "replace")
    if b.startswith(b"\xef\xbb\xbf"):
        return b[3:].decode("utf-8", "replace")
    if b.startswith((b"\xff\xfe", b"\xfe\xff")):
        return b.decode("utf-16", "replace")
    text = b.decode("utf-8", "replace")
    lost = text.count("�")
    if lost <= REPLACED * len(text):
        return text
    japanese = b.decode("cp932", "replace")
    return japanese if japanese.count("�") * len(text) < lost * max(1, len(japanese)) else text


def units(files: list[File]) -> list[File]:
    """Partitions of files: a workbook's sheets are one each."""
    out = []
    for f in files:
        if f.kind != "workbook":
            out.append(f)
            continue
        try:
            with book(f) as b:
                out += [File(f.root, f.path, f.at, s) for s in workbook.sheets(b)]
        except (OSError, zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
            out.append(File(f.root, f.path, f.at, None, said(e)))
    return out


def said(e: Exception) -> str:
    return re.sub(r"\s+", " ", f"{type(e).__name__}: {e}")


def rows_of(f: File, encoding: str | None = None) -> Iterator[pa.RecordBatch]:
    """A partition's rows."""
    at = datetime.fromtimestamp(f.at / 1e9, timezone.utc)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = zip(*((f.path, f.name, f.ext, f.kind, f.unit, *r, at) for r in held), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, ARROW, strict=True)], schema=ARROW)

    def found() -> Iterator[tuple]:
        if f.error is not None or f.kind == "other":
            yield None, None, f.error or f"unsupported: {f.ext} needs another program"
        elif f.kind == "workbook":
            with book(f) as b:
                for _, n, line in workbook.lines(b, f.unit):
                    yield n, line, None
        else:
            text = decoded(content(f), encoding)
            for n, line in enumerate(re.split("\r\n|\r|\n", text)[: -1 if not text or text.endswith(("\r", "\n")) else None], 1):
                yield n, line, None

    try:
        for r in found():
            held.append(r)
            if len(held) == BATCH:
                yield batch()
                held = []
    except (OSError, zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
        held.append((None, None, said(e)))
    if held:
        yield batch()


def chosen(options: dict) -> dict[str, list[str]]:
    """What the options ext and kind choose."""
    return {a: [v.strip().lower() for v in options[a].split(",")] for a in ("ext", "kind") if options.get(a)}


def taken(f: File, only: dict[str, list[str]]) -> bool:
    return all(getattr(f, a) in values for a, values in only.items())


class ShelfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.encoding, self.only = options["path"], options.get("encoding"), chosen(options)

    def partitions(self) -> list[File]:
        return units([f for f in listed(self.path) if taken(f, self.only)]) or [File("", "", 0, None, "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from rows_of(partition, self.encoding)


class InboxReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.encoding, self.only = options["path"], options.get("encoding"), chosen(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": "0", "seen": "[]"}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path)
        if not files:
            return self.initialOffset()
        return {"at": str(files[-1].at), "seen": json.dumps([f.path for f in files if f.at == files[-1].at])}

    def partitions(self, start: dict, end: dict) -> list[File]:
        a, b, seen, last = int(start["at"]), int(end["at"]), set(json.loads(start["seen"])), set(json.loads(end["seen"]))
        new = [f for f in listed(self.path) if taken(f, self.only) and (f.at > a or f.at == a and f.path not in seen) and (f.at < b or f.at == b and f.path in last)]
        return units(new) or [File("", "", 0, None, "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from rows_of(partition, self.encoding)

    def commit(self, end: dict) -> None:
        """Nothing to keep: offsets say what was read."""


class ShelfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shelf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ShelfReader:
        return ShelfReader(self.options)

    def streamReader(self, schema: object) -> InboxReader:  # noqa: N802
        return InboxReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known."""
    spark.dataSource.register(ShelfSource)
