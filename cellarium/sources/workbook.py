"""Workbooks (.xlsx, .xlsm) as relations: sheets, cells, merged ranges, hidden rows, errors.

Archives are read by Spark's binaryFile source and parsed in Arrow batches, one row out for each
fact. Values keep their type: v_str is the text, v_num the number where there is one.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, kind string, sheet_idx int, title string, state string, ord long, row int, col int, row2 int, col2 int, data_type string, v_str string, v_num double, formula string"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_REF = re.compile(r"([A-Za-z]+)([0-9]+)$")
#: What reading a damaged or encrypted member raises.
_BROKEN = (zipfile.BadZipFile, zlib.error, ET.ParseError, RuntimeError, NotImplementedError, EOFError)
_R_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _place(ref: str) -> tuple[int, int] | None:
    m = _REF.match(ref or "")
    if not m:
        return None
    col = 0
    for ch in m[1].upper():
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def _value(kind: str, raw: str | None, inline: str | None, strings: list[str]) -> tuple[str | None, float | None]:
    """(text, number) of a cell; numeric text of any other kind is a number, whole ones without ".0"."""
    if kind == "inlineStr":
        return inline, None
    if raw is None:
        return None, None
    if kind == "s":
        at = int(raw) if raw.strip().isdigit() else -1
        return (strings[at] if 0 <= at < len(strings) else ""), None
    if kind == "b":
        return ("True", 1.0) if raw.strip() == "1" else ("False", 0.0)
    if kind == "e":
        return raw, None
    try:
        number = float(raw)
    except ValueError:
        return raw, None
    if number != number or number in (float("inf"), float("-inf")):
        return raw, None
    return (str(int(number)) if number.is_integer() else repr(number)), number


def parse_workbook(doc_id: str, content: bytes, skip: re.Pattern | None = None) -> Iterator[dict]:
    """Facts of one archive; ``skip`` leaves out the cells of sheets with such titles."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        names = {n.lower(): n for n in archive.namelist()}
        book = ET.fromstring(archive.read(names["xl/workbook.xml"]))
    except (*_BROKEN, KeyError, OSError) as e:
        yield {"kind": "error", "v_str": f"not a workbook: {e}"}
        return

    def part(path: str) -> ET.Element | None:
        try:
            return ET.fromstring(archive.read(names[path.lower()]))
        except (*_BROKEN, KeyError):
            return None

    def rows_of(path: str) -> Iterator[ET.Element]:
        """Elements of a sheet as they end; what stands before the damage of a part is kept."""
        with archive.open(names[path.lower()]) as f:
            for _, e in ET.iterparse(f):
                if _tag(e) in ("row", "mergeCell"):
                    yield e
                    if _tag(e) == "row":
                        e.clear()

    rels = part("xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target", "") for r in rels} if rels is not None else {}
    shared = part("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in shared if _tag(si) == "si"] if shared is not None else []
    for idx, sheet in enumerate(s for s in book.iter() if _tag(s) == "sheet"):
        title, state = sheet.get("name", ""), (sheet.get("state") or "visible").lower()
        own = {"sheet_idx": idx, "title": title, "state": state}
        yield own | {"kind": "sheet"}
        if skip and skip.search(title):
            continue
        target = targets.get(sheet.get(_R_ID), f"worksheets/sheet{idx + 1}.xml")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        if path.lower() not in names:
            continue
        order, widest, last_row, merged = {}, 0, 0, []
        elements = rows_of(path)
        while True:
            try:
                row = next(elements, None)
            except _BROKEN:
                yield own | {"kind": "error", "v_str": f"unreadable sheet {title}"}
                break
            if row is None:
                break
            if _tag(row) == "mergeCell":
                merged.append(row.get("ref", ""))
                continue
            number = int(row.get("r")) if (row.get("r") or "").isdigit() else last_row + 1
            last_row = number
            if row.get("hidden") in ("1", "true"):
                yield own | {"kind": "hidden", "row": number}
            for c in row:
                if _tag(c) != "c":
                    continue
                at = _place(c.get("r", "")) or (number, widest + 1)
                widest = max(widest, at[1])
                v = next((x.text for x in c if _tag(x) == "v"), None)
                f = next((x.text or "" for x in c if _tag(x) == "f"), None)
                inline = next(("".join(t.text or "" for t in x.iter() if _tag(t) == "t") for x in c if _tag(x) == "is"), None)
                text, num = _value(c.get("t", "n"), v, inline, strings)
                if text is not None:
                    place = order.get(at, (len(order), None))[0]
                    order[at] = (place, own | {"kind": "cell", "ord": place, "row": at[0], "col": at[1], "data_type": c.get("t", "n"), "v_str": text, "v_num": num, "formula": f})
        yield from (fact for _, fact in order.values())
        for n, ref in enumerate(merged):
            a, _, b = ref.partition(":")
            a, b = _place(a), _place(b or a)
            if a and b:
                yield own | {"kind": "merge", "ord": n, "row": a[0], "col": a[1], "row2": b[0], "col2": b[1]}


def _parsed(batches: Iterator[pa.RecordBatch], skip: str | None) -> Iterator[pa.RecordBatch]:
    pattern = re.compile(skip, re.I) if skip else None
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows = [{**dict.fromkeys(_NAMES), **fact, "doc_id": path} for fact in parse_workbook(path, content, pattern)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def facts(files: DataFrame, skip: str | None = None) -> DataFrame:
    """files(path, content) to the facts of all workbooks."""
    return files.select("path", "content").mapInArrow(lambda b: _parsed(b, skip), SCHEMA)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Workbooks of a folder, or one file; lock files (~$) are left out."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.[xX][lL][sS][xXmM]").load(path)
    )
    return found.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def cells(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'cell'").select("doc_id", "sheet_idx", "ord", "row", "col", "data_type", "v_str", "v_num", "formula")


def merges(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'merge'").select(
        "doc_id", "sheet_idx", F.col("ord").alias("merge_ord"), F.col("row").alias("min_row"), F.col("col").alias("min_col"),
        F.col("row2").alias("max_row"), F.col("col2").alias("max_col"),
    )


def sheets(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'sheet'").select("doc_id", "sheet_idx", "title", "state")
