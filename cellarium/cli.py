"""Command line: extract a workbook or a folder to JSON, CSV and XLSX."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellarium", description="Quote items from workbooks")
    p.add_argument("path", nargs="?", help="a workbook or a folder")
    p.add_argument("-i", "--input", help="a workbook")
    p.add_argument("-d", "--directory", help="a folder")
    p.add_argument("-c", "--config", help="a settings file")
    p.add_argument("-v", "--verbose", action="store_true", help="list each workbook")
    p.add_argument("-o", "--output", default="output", help="folder of the results")
    p.add_argument("-f", "--format", default="both", choices=["json", "csv", "both", "all", "excel", "xlsx"])
    p.add_argument("--strict", action="store_true", help="exit with 2 if an item has a warning")
    p.add_argument("-r", "--recursive", action=argparse.BooleanOptionalAction, default=True)
    return p


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: wrong call; 2: a file failed, or strict and a warning."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    path = a.path or a.input or a.directory
    if not path or not os.path.exists(path) or (a.config and not os.path.exists(a.config)):
        print(f"no such path: {a.config if path and os.path.exists(path) else path}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .operators.documents import flat_rows, run_metrics
    from .plans.config import load
    from .plans.extract import documents, extract
    from .sources import sinks, workbook

    spark = SparkSession.builder.appName("cellarium").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    facts = workbook.facts(workbook.read_files(spark, path, a.recursive)).persist()
    items = extract(facts, load(a.config)).persist()
    rows = flat_rows(items)
    os.makedirs(a.output, exist_ok=True)
    if a.format in ("csv", "both", "all"):
        sinks.write_csv(rows, f"{a.output}/items_csv")
    if a.format in ("json", "both", "all"):
        sinks.documents_json(items.drop("sheet_idx"), ["doc_id", "source_file"], "seq").select("json").write.mode("overwrite").text(f"{a.output}/documents_json")
    if a.format in ("excel", "xlsx", "all"):
        sinks.write_xlsx({"ExtractedQuotes": rows}, f"{a.output}/items.xlsx")
    docs = documents(facts, items).persist()
    if a.verbose:
        for d in docs.orderBy("doc_id").toLocalIterator():
            print(f"{d.source_file}: {d.total_items} items, {d.n_warnings} warnings")
    m = run_metrics(docs).first()
    print(f"files {m.files}, quotes {m.quotes}, items {m['items']}, warnings {m.warnings}, failed files {m.failed_files}")
    failed, warned = m.failed_files, m.warnings
    return 2 if failed or (a.strict and warned) else 0


if __name__ == "__main__":
    sys.exit(main())
