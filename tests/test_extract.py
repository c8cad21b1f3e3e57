from cellarium.plans.extract import extract_directory
from cellarium.sources.sinks import xlsx_bytes


def sheet(cells: dict[str, object]):
    """Cells by coordinate as (columns, rows) for the writer: row 1 is the writer's header row."""
    import re

    grid: dict[int, dict[int, object]] = {}
    for ref, v in cells.items():
        m = re.match(r"([A-Z]+)(\d+)", ref)
        col = 0
        for ch in m[1]:
            col = col * 26 + ord(ch) - 64
        grid.setdefault(int(m[2]), {})[col] = v
    width = max(max(r) for r in grid.values())
    rows = [tuple(grid.get(n, {}).get(c) for c in range(1, width + 1)) for n in range(1, max(grid) + 1)]
    return list(rows[0]), rows[1:]


FORM = {
    "B2": "Quote Number:", "C2": "Q1001-1", "B10": "Part Number:", "C10": "2202046213000", "B11": "Part Description:",
    "C11": "Housing Sensor", "E10": "Drawing Number:", "F10": "DWG-8841-B", "B18": "Cycle Time (sec):", "C18": 24.5,
}
GRID = {"B2": "Quote Reference Number:", "C2": "Q4000"}
for c, h in zip("ABCDEFG", ("Item #", "Customer Part #", "Description", "Cavities", "Cycle Time (sec)", "Tool Cost", "Piece Price")):
    GRID[f"{c}7"] = h
for i, (p, ct) in enumerate((("MED-10492", 14.5), ("MED-10493", 22.0), ("MED-10494", 9.8)), 1):
    GRID |= {f"A{7 + i}": i, f"B{7 + i}": p, f"C{7 + i}": "Clip", f"E{7 + i}": ct}
GRID["A11"] = "Total"
GRID |= {"A12": 9, "B12": "MED-99999", "E12": 5.0}


def test_forms_and_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.xlsx").write_bytes(xlsx_bytes({"Quote Summary": sheet(FORM)}))
    (tmp_path / "sub/grid.xlsx").write_bytes(xlsx_bytes({"QuoteMatrix": sheet(GRID)}))
    (tmp_path / "~$lock.xlsx").write_bytes(b"no")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = {r.quote_item_number: r for r in extract_directory(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["Q1001-1", "Q4000-1", "Q4000-2", "Q4000-3"]
    one = rows["Q1001-1"]
    assert (one.part_number, one.cycle_time_sec, one.confidence, one.warnings) == ("2202046213000", 24.5, "high", [])
    assert (one.part_num_coord, one.cycle_time_coord, one.description) == ("C10", "C18", "Housing Sensor")
    assert [(rows[f"Q4000-{i}"].part_number, rows[f"Q4000-{i}"].cycle_time_sec) for i in (1, 2, 3)] == [("MED-10492", 14.5), ("MED-10493", 22.0), ("MED-10494", 9.8)]
    assert [rows[f"Q4000-{i}"].part_num_coord for i in (1, 2, 3)] == ["B8", "B9", "B10"]
    assert one.drawing_number == "DWG-8841-B"


def test_parts_from_quote_information_and_rate_from_another_sheet(spark, tmp_path):
    heads = ("Item #", "Part Number", "Description", "Cycle Time (sec)")
    table = lambda at, rows: {f"{c}{at}": h for c, h in zip("ABCD"[: len(rows[0])], heads)} | {
        f"{c}{at + 1 + n}": v for n, row in enumerate(rows) for c, v in zip("ABCD", row) if v is not None
    }
    mpc = {"F1": "Labour Rate", "F2": 48.5, "A1": "Quote Number", "B1": "Q4476"} | table(5, [(1, "AA-1001", "Clip", 10.0), (2, None, "Cap", 20.0), (None, "CC-1003", "Pin", 30.0)])
    info = table(3, [(1, "AA-1001", "Clip"), (2, "BB-1002", "Cap"), (7, "CC-1003", "Pin")])
    # without cycle times on the quote-information sheet the table of the MPC sheet is read
    (tmp_path / "q.xlsx").write_bytes(xlsx_bytes({"QInfo": sheet(info), "MPC": sheet(mpc)}))
    got = [(r.quote_item_number, r.part_number, r.labour_rate, r.part_num_coord) for r in extract_directory(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("Q4476-1", "AA-1001", 48.5, "MPC!B6"), ("Q4476-2", "BB-1002", 48.5, "MPC!B7"), ("Q4476-7", "CC-1003", 48.5, "MPC!B8")]


def test_checklist_above_the_table_is_no_header(spark, tmp_path):
    cells = {"A1": "Quote Number", "B1": "Q4509", "A3": "Part Number", "B3": "Cycle Time", "C3": "Description", "D3": "Material", "E3": "Weight (g)", "F3": "Ops"}
    cells |= {"A10": "Item #", "B10": "Part Number"} | {f"{c}{11 + n}": v for n in range(4) for c, v in (("A", n + 1), ("B", f"PN-{n}77"))}
    (tmp_path / "q.xlsx").write_bytes(xlsx_bytes({"Sheet1": sheet(cells)}))
    got = [(r.quote_item_number, r.part_number) for r in extract_directory(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(f"Q4509-{n + 1}", f"PN-{n}77") for n in range(4)]


def _tab(part=None, cycle=None, quote=None):
    cells = {"A1": "Form", "B4": "Note here"}
    cells |= {"B2": "Quote Number:", "C2": quote} if quote else {}
    cells |= {"B10": "Part Number:", "C10": part} if part else {}
    return sheet(cells | ({"B18": "Cycle Time (sec):", "C18": cycle} if cycle else {}))


def _numbers(spark, path):
    got = extract_directory(spark, str(path)).orderBy("doc_id", "sheet_idx").collect()
    return [(r.quote_item_number, r.part_number, r.part_num_coord) for r in got]


def test_every_tab_is_an_item_and_the_best_sheet_is_read(spark, tmp_path):
    one = {"Cover": _tab(quote="Q2005"), **{f"Item {i}": _tab(f"PN-{i}00", 10.0 + i, "Q2005") for i in (1, 2, 3)}}
    (tmp_path / "a.xlsx").write_bytes(xlsx_bytes(one))
    (tmp_path / "b.xlsx").write_bytes(xlsx_bytes({f"MPC {i}": _tab(f"MM-{i}00", 20.0, "Q2006") for i in (1, 2, 3)}))
    (tmp_path / "c.xlsx").write_bytes(xlsx_bytes({"Left": _tab("LL-100", 5.0), "Q2007-9": _tab("RR-100", 6.0), "Bare": _tab(), "Last": _tab(quote="Q2007")}))
    (tmp_path / "d.xlsx").write_bytes(xlsx_bytes({"MPC 1": _tab("AA-100", 5.0, "Q3001"), "MPC Quote": _tab("BB-100", 5.0, "Q3001-4")}))
    (tmp_path / "e.xlsx").write_bytes(xlsx_bytes({"Other": _tab("CC-100", 5.0), "mpc_quote": _tab("DD-100", 5.0)}))
    (tmp_path / "f.xlsx").write_bytes(xlsx_bytes({"Summary": _tab(quote="Q3003"), "Terms": _tab("EE-100", 7.0)}))
    assert _numbers(spark, tmp_path) == [
        *((f"Q2005-{i}", f"PN-{i}00", f"Item {i}!C10") for i in (1, 2, 3)), *((f"Q2006-{i}", f"MM-{i}00", f"MPC {i}!C10") for i in (1, 2, 3)),
        ("Q2007-1", "LL-100", "Left!C10"), ("Q2007-9", "RR-100", "Q2007-9!C10"), ("Q2007-3", None, None),
        ("Q3001-4", "BB-100", "MPC Quote!C10"), ("Q0000-1", "DD-100", "mpc_quote!C10"), ("Q3003-1", "EE-100", "Terms!C10"),
    ]


def test_labels_of_forms(spark, tmp_path):
    form = {
        "B2": "Quote Number", "C2": "Q1500-1", "B3": "Part Number : PN-777", "C3": "PN-888", "B4": "Part Number Item", "C4": "PN-999", "B5": "Cycle Time", "C5": "#N/A",
        "B6": "Material Supplier", "C6": "ACME", "B7": "Material", "C7": "PA66", "B8": "Resin Grade", "C8": "Zytel", "B9": "Labour", "B10": "Rate $/hr", "B11": 31.5,
        "B14": "Description", "E14": "Clip: left", "B15": "Ops", "C15": "none", "D15": 0.5,
    }
    (tmp_path / "a.xlsx").write_bytes(xlsx_bytes({"Sheet": sheet(form)}))
    r = extract_directory(spark, str(tmp_path)).first()
    assert (r.quote_item_number, r.part_number, r.part_num_coord) == ("Q1500-1", "PN-777", "B3")  # what stands behind the colon comes first
    assert (r.cycle_time_sec, r.cycle_time_coord, r.material, r.material_coord) == (None, "C5", "Zytel", "C8")
    assert (r.labour_rate, r.labour_rate_coord, r.description, r.ops_labour, r.ops_labour_coord) == (31.5, "B11", "Clip: left", 0.5, "D15")
