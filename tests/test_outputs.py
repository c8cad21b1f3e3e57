import json

from pyspark.sql import functions as F

from cellarium import cli
from cellarium.operators import display, documents, link
from cellarium.plans import config
from cellarium.sources import jobs, sinks, workbook
from cellarium.streaming.watch import watch

from test_extract import FORM, GRID, sheet


def test_settings(tmp_path):
    assert config.load(str(tmp_path / "none.yaml")) == config.Config()
    (tmp_path / "bad.yaml").write_text("a: [")
    assert config.load(str(tmp_path / "bad.yaml")) == config.Config()
    flat = config.parse({"anchors": {"part_number": {"keywords": ["My Part"]}}, "sheets": {"ignore": ["junk"]}, "bounds": {"cycle_time_sec": {"max": 99}}})
    assert flat == config.parse({"extraction": {"anchors": {"part_number": {"anchors": ["my part"]}}, "sheets": {"ignore": ["junk"]}, "bounds": {"cycle_time_sec": {"max": 99}}}})
    assert (flat.anchors["part_number"], flat.ignored_sheets, flat.most_cycle, flat.least_cycle) == (("my part",), ("junk",), 99.0, 5.0)
    assert config.parse(["odd"]) == config.Config()


def test_job_sheets(spark, tmp_path):
    cells = {"A1": "List", "B2": "Part No", "C2": "Job Number", "C3": "J1", "B3": "P-1", "B4": "P-2", "C5": "nan", "B5": "-", "C6": "J4"}
    (tmp_path / "jobs.xlsx").write_bytes(sinks.xlsx_bytes({"S": sheet(cells)}))
    (tmp_path / "jobs.csv").write_text('Job,Part\nJ1,"P-1"\n\nJ2;P-2\n')
    got = jobs.parse_job_sheets(workbook.facts(workbook.read_files(spark, str(tmp_path)))).orderBy("original_index").collect()
    assert [(r.job_number, r.part_number) for r in got] == [("J1", "P-1"), ("JOB-2", "P-2"), ("J4", "")]
    got = jobs.read_job_csv(spark, str(tmp_path / "jobs.csv")).orderBy("line_no").collect()
    assert [(r.job_number, r.part_number) for r in got] == [("J1", "P-1"), ("J2", "P-2")]


def test_linked_workbook_and_quote_files(spark, tmp_path):
    quotes = spark.createDataFrame(
        [(0, "PN-100", "", "Q1-1", "Clip", None, 10.0, 0.5, 48.5, None, 100, "high"), (1, "PN-200", "", "Q1-2", "Cap", "PA66", 12.0, 0.5, 48.5, 1.5, None, "low")],
        "quote_ord long, part_number string, drawing_number string, quote_item_number string, description string, material string, cycle_time_sec double, ops_labour double, labour_rate double, weight_g double, annual_volume long, confidence string",
    )
    found = link.link(spark.createDataFrame([(0, "J1", "PN-100"), (1, "J2", "XX")], "job_ord int, job_number string, part_number string"), quotes)
    rows = display.linked_rows(found, quotes.drop("drawing_number", "confidence"))
    sinks.write_linked(rows, display.unlinked_rows(link.unlinked(quotes, found)), str(tmp_path / "l.xlsx"))
    cells = workbook.facts(workbook.read_files(spark, str(tmp_path / "l.xlsx")))
    assert [r.title for r in workbook.sheets(cells).orderBy("sheet_idx").collect()] == ["Linked Jobs", "Quotes Missing Jobs"]
    texts = {(r.sheet_idx, r.row, r.col): r.v_str for r in workbook.cells(cells).collect()}
    assert (texts[0, 2, 1], texts[0, 2, 3], texts[0, 2, 11], texts[0, 3, 11]) == ("J1", "Q1-1", display.MATCHED, display.NO_QUOTE)
    assert (texts[1, 2, 1], texts[1, 2, 11]) == ("Q1-2", display.NO_JOB)
    docs = spark.createDataFrame([("Q1", "a.xlsx", '{"n":1}'), ("Q1", "b.xlsx", '{"n":2}'), ("Q/2", "c.xlsx", '{"n":3}')], "quote_id string, source_file string, json string")
    sinks.write_quote_files(docs, str(tmp_path / "q"))
    assert {p.name: json.loads(p.read_text())["n"] for p in (tmp_path / "q").iterdir()} == {"Q1.json": 2, "Q_2.json": 3}
    assert sorted(r.n for r in sinks.read_documents(docs, "n int").collect()) == [1, 2, 3]


def test_display_handles_blanks(spark):
    c = spark.createDataFrame([(None, "A1")], "a string, b string")
    two = c.withColumns({f"{n}_coord": F.lit(None).cast("string") for n in display.COORD_TAGS})
    assert two.select(display.coords_text()).first()[0] == "-"
    assert display.matching(c, " a1 ").count() == 1 and display.matching(c, "zz").count() == 0


def test_command_line_and_watch(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.xlsx").write_bytes(sinks.xlsx_bytes({"Quote Summary": sheet(FORM)}))
    (src / "bad.xlsx").write_bytes(b"no zip")
    assert cli.main([str(src / "missing")]) == 1
    assert cli.main(["-d", str(src), "-o", str(tmp_path / "out"), "-f", "all", "-v"]) == 2
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"items_csv", "documents_json", "items.xlsx"}
    doc = json.loads(spark.read.text(str(tmp_path / "out/documents_json")).first()[0])
    assert doc["total_items"] == 1 and doc["items"][0]["quote_item_number"] == "Q1001-1"
    (src / "bad.xlsx").unlink()
    for _ in range(2):  # the second run finds nothing new
        watch(spark, str(src), str(tmp_path / "seen"), str(tmp_path / "state")).awaitTermination()
    assert [r.quote_item_number for r in spark.read.parquet(str(tmp_path / "seen")).collect()] == ["Q1001-1"]


def _damaged(kind):
    import io
    import zipfile

    good = sinks.xlsx_bytes({"Quote": sheet({"B2": "Quote Number:", "C2": "Q1001-1", "B10": "Part Number:", "C10": "PN-100"})})
    if kind == "zip":
        return good[: len(good) // 2]
    out, source = io.BytesIO(), zipfile.ZipFile(io.BytesIO(good))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in source.namelist():
            body = source.read(name)
            if "sheet1" in name and kind == "row":
                body = body.replace(b'<row r="2"', b'<row r="x"')
            if "sheet1" in name and kind == "cut":
                body = body[: body.index(b'<row r="10"') + 20]
            z.writestr(name, body)
    raw = out.getvalue()
    if kind in ("zlib", "locked"):
        raw = bytearray(raw)
        for info in zipfile.ZipFile(io.BytesIO(bytes(raw))).infolist():
            if "sheet1" in info.filename:
                if kind == "zlib":
                    at = info.header_offset + 30 + len(info.filename)
                    raw[at : at + 12] = b"\xff" * 12
                else:
                    raw[info.header_offset + 6] |= 1
                    at = bytes(raw).rindex(info.filename.encode())
                    raw[at - 46 + 8] |= 1
    return bytes(raw)


def test_damaged_workbooks_end_no_job(spark, tmp_path):
    kinds = ("good", "zip", "row", "cut", "zlib", "locked")
    for kind in kinds:
        (tmp_path / f"{kind}.xlsx").write_bytes(_damaged(kind))
    facts = workbook.facts(workbook.read_files(spark, str(tmp_path))).withColumn("file", F.regexp_extract("doc_id", r"(\w+)\.xlsx$", 1)).collect()
    cells = {k: [(r.row, r.col, r.v_str) for r in facts if r.file == k and r.kind == "cell"] for k in kinds}
    errors = {r.file for r in facts if r.kind == "error"}
    assert errors == {"zip", "cut", "zlib", "locked"}
    assert len(cells["good"]) == 4 and len(cells["row"]) == 4 and cells["cut"] == cells["good"][:2]
    assert not cells["zip"] and not cells["zlib"] and not cells["locked"]


def test_job_text_is_csv(spark):
    lines = ["", "Job,Part", 'J1,"A,B"', '"J""2", P-2 ', "J3"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "job_text_id int, line_no int, line string")
    got = jobs.parse_job_text(df).orderBy("line_no").collect()
    assert [(r.job_number, r.part_number) for r in got] == [("J1", "A,B"), ('J"2', "P-2"), ("J3", "")]


def test_reports_as_bytes(spark, tmp_path):
    items = spark.createDataFrame([("a", 1, "Öl", None), ("a", 2, None, 2.5), ("b", 1, "x", 1.0)], "doc string, n int, t string, v double")
    docs = sinks.documents_json(items, ["doc"], "n")
    one = docs.filter("doc = 'a'")
    want = {"doc": "a", "total_items": 2, "items": [{"n": 1, "t": "Öl", "v": None}, {"n": 2, "t": None, "v": 2.5}]}
    assert json.loads(sinks.json_bytes(one)) == want and json.loads(sinks.json_bytes(one, as_list=True)) == [want]
    assert "Öl".encode() in sinks.json_bytes(one)
    assert len(json.loads(sinks.json_bytes(docs, as_list=False))) == 2 and json.loads(sinks.json_bytes(docs.limit(0))) == []
    back = sinks.document_items(sinks.read_documents(docs, sinks.document_schema(items, ["doc"])), ["doc"])
    assert sorted(back.collect()) == sorted(items.collect())
    assert sinks.csv_bytes(items.filter("n = 2")) == b"doc,n,t,v\na,2,,2.5\n"
    sinks.export_json(one, str(tmp_path / "new/d.json"))
    sinks.export_dataframe(items, str(tmp_path / "new/d.xlsx"), "S")
    assert json.loads((tmp_path / "new/d.json").read_text()) == want
    assert [r.title for r in workbook.sheets(workbook.facts(workbook.read_files(spark, str(tmp_path / "new/d.xlsx")))).collect()] == ["S"]


def test_frames_and_key_figures(spark):
    none = spark.createDataFrame([], "quote_item_number string, confidence string, warnings array<string>, d int")
    assert documents.frame(none).columns[0] == "quote_item_number" and len(documents.frame(none).columns) == 22 and documents.frame(none).count() == 0
    some = spark.createDataFrame([("Q1234-1", "high", [], 1), ("Q1234-2", "medium", [], 1), ("x", "high", [], 2)], none.schema)
    assert {tuple(r) for r in documents.key_figures(some, ["d"], "quote_item_number").collect()} == {(1, "Q1234", 2, "MEDIUM"), (2, "N/A", 1, "HIGH")}
