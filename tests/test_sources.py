import io
import struct
import zipfile
import zlib

import pytest
from lyceum.functions import vocabulary
from lyceum.sources import files, sinks
from lyceum.streaming import events


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t><w:br w:type="page"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = archive(
    {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>hello</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="b"><v>1</v></c><c r="D1"/></row></sheetData></worksheet>',
    }
)


def test_office_files_and_pages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.xlsx").write_bytes(XLSX)
    (tmp_path / "c.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "d.md").write_bytes("这是一个中文文档".encode("gbk"))
    (tmp_path / "broken.docx").write_bytes(b"PK nothing")
    (tmp_path / "references").mkdir()
    (tmp_path / "references" / "x.txt").write_text("generated")
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 5
    assert [(r.page, r.kind, r.text) for r in files.office_elements(found).orderBy("ordinal").collect()] == [(1, "heading", "Title"), (1, "text", "one\n"), (2, "table", "a\tb")]
    assert [(r.cell, r.type, r.value, r.formula) for r in files.sheet_cells(found).orderBy("cell").collect()] == [("A1", "string", "hello", None), ("B1", "number", "2", "1+1"), ("C1", "boolean", "true", None)]
    assert sorted((r.path[-5:], r.page, r.text) for r in files.text_pages(found).collect()) == [("/d.md", 1, "这是一个中文文档"), ("c.txt", 1, "one"), ("c.txt", 2, "two")]
    assert {r.text for r in files.text_pages(found).collect()} == {"one", "two", "这是一个中文文档"}


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0) + struct.pack(">I", zlib.crc32(b""))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (png(3, 5), ("png", 3, 5)), (b"GIF89a" + struct.pack("<HH", 7, 9), ("gif", 7, 9)), (b"BM" + bytes(16) + struct.pack("<ii", 4, -6), ("bmp", 4, 6)),
        (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x0a\x00\x14", ("jpeg", 20, 10)), (b"II*\x00\x08\x00\x00\x00\x02\x00" + struct.pack("<HHIHH", 256, 3, 1, 30, 0) + struct.pack("<HHII", 257, 4, 1, 40), ("tiff", 30, 40)),
        (b"RIFF\x00\x00\x00\x00WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), ("webp", 100, 50)), (b"\x89PNG\r\n\x1a\n", None), (b"", None), (b"BM", None), (png(0, 5), None),
    ],
)
def test_image_headers(raw, want):
    assert files.image_size(raw) == want


def test_json_lines_are_strict(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# note\n{"b": 1, "a": [2]}\n\n{"a": 1, "a": 2}\n{"a": NaN}\n')
    got = files.json_lines(spark, str(tmp_path / "x.jsonl"), comments=True).collect()
    assert [r.json for r in got if r.problem is None] == ['{"a":[2],"b":1}'] and len(got) == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, None)], "id int, cell string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert {r.cell for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} == {"'=1+1", None}
    sinks.write_jsonl(df, f"{tmp_path}/jsonl")
    assert {r.value for r in spark.read.text(f"{tmp_path}/jsonl").collect()} == {'{"cell":"=1+1","id":1}', '{"cell":null,"id":2}'}
    sinks.export_sqlite(df, df.select("id"), f"{tmp_path}/q.db")
    (tmp_path / "other").write_text("text")
    with pytest.raises(ValueError):
        sinks.export_sqlite(df, df, f"{tmp_path}/other")
    entry = spark.createDataFrame([("r", "drift", 0.1, "2024-01-01T00:00:00")], "run_id string, kind string, cost_usd double, created_at string")
    sinks.append_ledger(entry, f"{tmp_path}/ledger")
    sinks.append_ledger(entry, f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 2
    with pytest.raises(ValueError):
        sinks.append_ledger(entry.replace("drift", "nothing"), f"{tmp_path}/ledger")


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", i % 3, "view") for i in range(30)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type")
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    query = events.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = {(r.start, r.n) for r in events.tumbling(table, "1 hour").collect()}
    assert {(r.start, r.n) for r in spark.table("hours").collect()} == want
    drained = events.drain(events.tumbling(stream, "1 hour", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/c2")
    assert drained.awaitTermination(120)
    assert {(r.start, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} <= want
    assert events.sessions(table, 3600).agg({"n": "sum"}).first()[0] == 30


def test_banks_are_arrays_of_objects_with_ids(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"id": 1, "q": "树"}, 5, {"q": "no id"}, {"id": "b", "o": ["x"]}]', encoding="utf-8")
    (tmp_path / "object.json").write_text('{"id": 1}')
    (tmp_path / "twice.json").write_text('[{"id": 1, "id": 2}]')
    (tmp_path / "bytes.json").write_bytes(b"\xff\xfe")
    docs = files.json_documents(spark, str(tmp_path))
    got = sorted((r.path.rsplit("/", 1)[-1], r.position, r.item, r.problem) for r in files.bank_items(docs).collect())
    assert [x[:3] for x in got if x[0] == "good.json"] == [("good.json", 0, '{"id":1,"q":"树"}'), ("good.json", 3, '{"id":"b","o":["x"]}')]
    assert {x[0]: x[3] for x in got if x[3]}.keys() == {"object.json", "twice.json", "bytes.json"}


@pytest.mark.parametrize(
    ("path", "want"),
    [("exams/1.pdf", True), ("exams/sorting.pdf", False), ("midterm1.pdf", True), ("example.pdf", False), ("exams/期末复习笔记.pdf", False), ("final_version.pdf", False), ("finalanswers.pdf", False), ("midtermsolutions.pdf", True), ("真题/A卷.pdf", True), ("midterm_notes/2.pdf", False), (None, False), ("", False)],
)
def test_exam_paths(path, want):
    assert vocabulary.is_exam_path(path) is want


def test_papers_in_an_exam_root():
    assert vocabulary.is_exam_path("2.pdf", "past papers") and not vocabulary.is_exam_path("2.pdf", "lectures")
