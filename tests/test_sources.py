"""Workbooks, shared files, sources of the query tables that no SQL can express."""

import zipfile

import pytest

from tessel.sources import files, shared, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(path, sheets, shared_strings=()):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {LINK}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        if shared_strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in shared_strings) + "</sst>")
        for i, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks_become_lines(spark, tmp_path):
    first = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1"/><c r="C1"><v>4.5</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t><t>line</t></is></c></row>'
    make_workbook(tmp_path / "a.XLSX", {"One": first, "二": '<row r="9"><c r="AA9"><v>7</v></c></row>'}, ["x", "規程"])
    make_workbook(tmp_path / "~$a.xlsx", {"One": first}, ["x", "y"])
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "note.txt").write_text("text")
    rows = workbook.sheet_lines(spark, str(tmp_path)).collect()
    good = sorted((r.sheet, r.row, r.line) for r in rows if r.error is None)
    assert good == [("One", 1, "[A1]規程\t[C1]4.5"), ("One", 3, "[B3]inline"), ("二", 9, "[AA9]7")]
    assert [r.path.rsplit("/", 1)[-1] for r in rows if r.error] == ["broken.xlsx"]


def test_work_is_tried_again():
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert shared.retried(work, pause=0.01) == "done" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        shared.retried(work, tries=2, pause=0.01)


def test_shared_texts_replace_whole(spark, tmp_path):
    path = str(tmp_path / "f.txt")
    for text in ("first é\n", "", "second\r\n"):
        shared.write_text(spark, path, text)
        assert shared.read_text(spark, path) == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["f.txt"]


def test_folder_lists_supported_files(spark, tmp_path):
    for n in ("a.TXT", "~$b.docx", "c.bin", "d.pdf"):
        (tmp_path / n).write_text("x")
    assert {r.file_name for r in files.folder(spark, str(tmp_path)).collect()} == {"a.TXT", "d.pdf"}


def test_update_mode_needs_keys(spark):
    from tessel.streaming import stream

    e = stream.event_stream(spark, "/root/testdata/sf0.001", "events.parquet")
    with pytest.raises(ValueError):
        stream.drained(e.groupBy("user_id").count(), "update")


def test_ingest_run_fills_every_table(spark):
    from pyspark.sql import functions as F

    from tessel.functions.python import mock_embedding
    from tessel.operators import chain

    body = "第1章 総則\n第1条 目的を定める。詳しくは第3条。\n" + "本文です。" * 60 + "\n第2章 手続\n第3条 手続を定める。\n" + "手続の本文。" * 60
    pages = spark.createDataFrame([("a.txt", body), ("b.txt", body), ("c.txt", "short note with FAIL"), ("d.txt", " ")], "source string, text string")
    held = spark.createDataFrame([], "source string, full_text string")
    manifest = spark.createDataFrame([("a.txt", "failed", 0, 2), ("z.txt", "done", 4, 0)], "file_path string, status string, chunk_count long, streak int")

    def embed(texts):
        return [None if "FAIL" in t else mock_embedding(t, 8) for t in texts]

    def summary(text):
        return F.struct(F.substring(text, 1, 5).alias("summary"), F.lit("k").alias("keywords"))

    out = chain.ingest(pages, held, manifest, "self", embed, summary, least=0)
    chunks = out.chunks.collect()
    ids = {r.chunk_id for r in chunks}
    assert len(ids) == len(chunks) and {r.source for r in chunks} == {"a.txt", "b.txt", "c.txt"}
    assert {r.chunk_id for r in out.meta.collect()} == ids
    assert {r.chunk_id: r.embedded for r in out.vectors.collect()} == {r.chunk_id: r.source != "c.txt" for r in chunks}
    m = {r.file_path: (r.status, r.streak) for r in out.manifest.collect()}
    assert m == {"a.txt": ("done", 0), "b.txt": ("done", 0), "c.txt": ("partial", 0), "d.txt": ("done", 0), "z.txt": ("done", 0)}
    outline = out.outline.orderBy("source", "n").collect()
    assert [r.chap for r in outline if r.source == "a.txt"][:2] == ["第1章 総則", "第2章 手続"] and all(r.summary for r in outline)
    assert out.links.count() > 0


def test_small_files_have_no_checksum_files(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.range(30).selectExpr("concat_ws('\t', id, 'é')").repartition(3).write.options(**files.SMALL).option("maxRecordsPerFile", 1).text(at)
    names = [p.name for p in (tmp_path / "in").iterdir()]
    assert len(names) == 31 and not [n for n in names if n.startswith(".")]
    assert sorted((int(r.a), r.b) for r in files.inbox_files(spark, at, ["a", "b"]).collect()) == [(i, "é") for i in range(30)]
