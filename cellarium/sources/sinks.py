"""Sinks for flat rows: CSV, JSON documents, and XLSX written from scratch."""

from __future__ import annotations

import csv
import io
import json
import math
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty. A folder of part files, written by all tasks."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def documents_json(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One JSON text for each document, with its items in order and nulls kept."""
    cols = [c for c in items.columns if c not in keys]
    docs = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("item")))).alias("i"))
    body = F.struct(*keys, F.size("i").alias("total_items"), F.transform("i", lambda x: x["item"]).alias("items"))
    return docs.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def col_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _clean(s: str) -> str:
    return escape("".join(c for c in s if c >= " " or c in "\t\n\r"), {'"': "&quot;"})


def xlsx_bytes(tables: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """A workbook with one sheet for each (columns, rows); texts are shared, blanks leave no cell."""
    strings: dict[str, int] = {}
    parts: dict[str, str] = {}
    for n, (columns, rows) in enumerate(tables.values(), 1):
        lines = []
        for r, row in enumerate([tuple(columns), *rows], 1):
            out = []
            for c, v in enumerate(row, 1):
                at = f"{col_name(c)}{r}"
                if v is None or v == "" or (isinstance(v, float) and not math.isfinite(v)):
                    continue
                if isinstance(v, bool):
                    out.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    out.append(f'<c r="{at}"><v>{v!r}</v></c>')
                else:
                    out.append(f'<c r="{at}" t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>')
            lines.append(f'<row r="{r}">{"".join(out)}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    names = list(tables)
    sheets = "".join(f'<sheet name="{_clean(t)[:31]}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(names, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    parts |= {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/>{over}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{rels}<Relationship Id="rId{len(names) + 1}" Type="{_REL}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'{_HEAD}<sst xmlns="{_MAIN}">' + "".join(f'<si><t xml:space="preserve">{_clean(s)}</t></si>' for s in strings) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """Frames as sheets of one workbook, through the driver: a report for people, not a bulk sink."""
    write_bytes(xlsx_bytes({name: (df.columns, (tuple(r) for r in df.toLocalIterator())) for name, df in tables.items()}), path)


def write_linked(linked: DataFrame, unlinked: DataFrame, path: str) -> None:
    """Linked jobs in their order, and the quotes that no job took, as two sheets (see ``display``)."""
    write_xlsx({"Linked Jobs": linked.orderBy("job_ord").drop("job_ord"), "Quotes Missing Jobs": unlinked.orderBy("quote_ord").drop("quote_ord")}, path)


def write_quote_files(documents: DataFrame, path: str) -> None:
    """documents(quote_id, source_file, json) as ``<quote_id>.json`` files; of one id the last by source_file.

    Files are written by the tasks through ``pyarrow.fs``; a task that runs again writes the same.
    """
    last = documents.groupBy("quote_id").agg(F.max_by("json", "source_file").alias("json"))

    def put(rows: Iterable) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(base, recursive=True)
        for r in rows:
            name = "".join(c if c.isalnum() or c in "-_." else "_" for c in r["quote_id"] or "quote")
            with store.open_output_stream(f"{base}/{name}.json") as f:
                f.write(r["json"].encode())

    last.foreachPartition(put)


def read_documents(texts: DataFrame, schema: str | StructType) -> DataFrame:
    """Document texts (json) back to columns of ``schema``."""
    return texts.select(F.from_json("json", schema).alias("d")).select("d.*")


def document_schema(items: DataFrame, keys: list[str]) -> StructType:
    """The schema of the texts that ``documents_json`` makes of these items."""
    item = StructType([f for f in items.schema if f.name not in keys])
    return StructType([*(items.schema[k] for k in keys), StructField("total_items", LongType()), StructField("items", ArrayType(item))])


def document_items(documents: DataFrame, keys: list[str]) -> DataFrame:
    """The items of documents that were read back, one row each with the documents' keys."""
    return documents.select(*keys, F.inline("items"))


def json_bytes(documents: DataFrame, as_list: bool | None = None, indent: int = 2) -> bytes:
    """Documents (json) as one text: one alone is an object, several are an array; ``as_list`` decides for one.

    Through the driver: a report, not a bulk sink. Nulls stay and letters stand as they are. No document: an empty array.
    """
    docs = [json.loads(r["json"]) for r in documents.select("json").toLocalIterator()]
    alone = len(docs) == 1 and not as_list
    return json.dumps(docs[0] if alone else docs, indent=indent, ensure_ascii=False).encode()


def csv_bytes(rows: DataFrame) -> bytes:
    """Flat rows as one CSV text with a header, nulls empty: a report through the driver."""
    out = io.StringIO()
    put = csv.writer(out, lineterminator="\n")
    put.writerow(rows.columns)
    put.writerows(["" if v is None else v for v in r] for r in rows.toLocalIterator())
    return out.getvalue().encode()


def frame_bytes(df: DataFrame, sheet_name: str = "Extracted Quotes") -> bytes:
    """Any frame as a workbook of one sheet: a report through the driver."""
    return xlsx_bytes({sheet_name: (df.columns, (tuple(r) for r in df.toLocalIterator()))})


def write_bytes(content: bytes, path: str) -> None:
    """One file through ``pyarrow.fs``, on a local path or in a store that a URI names; folders are made."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if "/" in base:
        store.create_dir(base.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(base) as f:
        f.write(content)


def write_json(documents: DataFrame, path: str, as_list: bool | None = None, indent: int = 2) -> None:
    """``json_bytes`` as one file."""
    write_bytes(json_bytes(documents, as_list, indent), path)


def write_frame(df: DataFrame, path: str, sheet_name: str = "Extracted Quotes") -> None:
    """``frame_bytes`` as one file."""
    write_bytes(frame_bytes(df, sheet_name), path)


# The short names of the sinks.
export_json, export_csv, export_excel, export_dataframe = write_json, write_csv, write_xlsx, write_frame
