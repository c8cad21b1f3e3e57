"""Registered queries: each operator over a whole table of the driver's schema.

Texts that look like workbook contents are made from keys by the SQL snippets below; the oracles
use the same snippets, so both sides read the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.constants import ANCHORS, RATE_ANCHORS
from ..operators import cells, display, documents, grid, link, sheets, validate
from ..sources import sinks
from ..sources.jobs import parse_job_text

PK = "CAST(p_partkey AS STRING)"
PART_TEXT = f"""CASE p_partkey % 10
 WHEN 0 THEN concat('  22020', {PK}, '-01 ') WHEN 1 THEN concat('3042', {PK}, 'C (DWG 40-A)')
 WHEN 2 THEN concat('8580', {PK}, ' [P09', {PK}, ']') WHEN 3 THEN concat('40601-BBA', {PK}, ' (LW)')
 WHEN 4 THEN '#N/A' WHEN 5 THEN concat('Strategic Fit ', {PK}) WHEN 6 THEN concat('why ', {PK}, '?')
 WHEN 7 THEN concat('a b c ', {PK}) WHEN 8 THEN concat('DWG_', {PK}, '_REV_A') ELSE concat('PN-', {PK}, '_r1') END"""
CELL_TEXT = """CASE l_linenumber % 8
 WHEN 0 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), '.5 sec ') WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' seconds')
 WHEN 2 THEN '#REF!' WHEN 3 THEN concat('$1,', CAST(100 + CAST(l_quantity AS INT) AS STRING), '.25')
 WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ',000 EAU') WHEN 5 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.0g')
 WHEN 6 THEN CASE l_partkey % 5 WHEN 0 THEN concat('abc 3.', CAST(l_partkey % 1000 AS STRING)) WHEN 1 THEN concat('1,', CAST(250 + l_partkey % 9 AS STRING)) WHEN 2 THEN concat(CAST(l_partkey % 97 AS STRING), '.675 Sec/Shot')
  WHEN 3 THEN concat(CAST(l_partkey % 97 AS STRING), '.285 Labour') ELSE concat('-', CAST(CAST(l_quantity AS INT) AS STRING)) END ELSE concat('0.', CAST(CAST(l_quantity AS INT) AS STRING), ' ops') END"""
TYPED = "CAST(CASE WHEN l_linenumber = 5 THEN -1 ELSE 1 END * (l_partkey % 997) + CAST(l_suppkey % 200 * 5 AS DOUBLE) / 1000 AS DOUBLE)"
QUOTE_TEXT = """CASE o_orderkey % 6
 WHEN 0 THEN concat('Q', CAST(1000 + o_custkey AS STRING)) WHEN 1 THEN concat('Q', CAST(1000 + o_custkey AS STRING), '-', CAST(o_orderkey % 7 + 1 AS STRING))
 WHEN 2 THEN concat('Q', CAST(1000 + o_custkey AS STRING), '-R3') WHEN 3 THEN concat(CAST(1000 + o_custkey AS STRING), '')
 WHEN 4 THEN concat('q', CAST(1000 + o_custkey AS STRING), '-', CAST(o_orderkey % 5 + 1 AS STRING), ' (2140)') ELSE '' END"""
ITEM_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN concat('Item ', CAST(o_orderkey % 9 + 1 AS STRING)) WHEN 1 THEN concat('#', CAST(o_orderkey % 9 + 1 AS STRING))
 WHEN 2 THEN '-' ELSE CAST(o_orderkey % 9 + 1 AS STRING) END"""
TITLE = """CASE WHEN floor(p_partkey / 5) % 7 = 0 THEN concat('MPC ', CAST(p_partkey % 5 + 1 AS STRING)) WHEN floor(p_partkey / 5) % 7 = 1 THEN concat('Quote Info-', CAST(p_partkey % 5 + 1 AS STRING))
 WHEN floor(p_partkey / 5) % 7 < 4 THEN CASE p_partkey % 11 WHEN 0 THEN 'mpc_quote' WHEN 1 THEN 'MPC 1' WHEN 2 THEN 'Note' WHEN 3 THEN 'MPC Quote' WHEN 4 THEN 'Term Sheet' WHEN 5 THEN 'Q-Info' WHEN 6 THEN 'My QInfo tab'
  WHEN 7 THEN 'Covers' WHEN 8 THEN 'MPC rfq 2' WHEN 9 THEN concat('Q', CAST(1000 + p_partkey AS STRING), '-2') ELSE concat('Part-', CAST(p_size AS STRING)) END
 ELSE CASE p_partkey % 9 WHEN 0 THEN 'MPC' WHEN 1 THEN 'MPC Old' WHEN 2 THEN 'QInfo' WHEN 3 THEN 'Quote Info 2' WHEN 4 THEN 'Summary'
 WHEN 5 THEN 'Lookups' WHEN 6 THEN concat('Item ', CAST(p_partkey AS STRING)) WHEN 7 THEN 'Cover Sheet' ELSE 'Old MPC (Copy)' END END"""
ITEMS = """l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_orderkey % 11 = 0 THEN concat('Q', CAST(1000 + l_orderkey % 9000 AS STRING)) ELSE concat('Q', CAST(1000 + l_orderkey % 9000 AS STRING), '-', CAST(l_linenumber AS STRING)) END AS quote_item_number,
 CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE concat('PN', CAST(l_partkey AS STRING)) END AS part_number,
 CASE WHEN l_suppkey % 5 = 0 THEN CAST(123456 + l_partkey AS STRING) ELSE 'Handle' END AS description,
 CASE l_partkey % 4 WHEN 0 THEN '40601-BBA001' WHEN 1 THEN 'NO MAT IDENTIFIED' WHEN 2 THEN 'Zytel 101L' ELSE NULL END AS material,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 8.0 END AS cycle_time_sec, l_tax * 20.0 AS ops_labour,
 l_quantity + 0.5 AS labour_rate, l_extendedprice AS weight_g, CAST(l_partkey % 50 AS BIGINT) * 400000 AS annual_volume"""
LABELS = """CASE p_partkey % 12 WHEN 0 THEN 'Customer Part #' WHEN 1 THEN 'Cycle Time (sec)' WHEN 2 THEN 'Part Description' WHEN 3 THEN 'Resin Grade'
 WHEN 4 THEN 'Material Supplier' WHEN 5 THEN '# Ops' WHEN 6 THEN 'Tool #' WHEN 7 THEN 'Part Weight (g)' WHEN 8 THEN 'Ann. Volume (EAU):'
 WHEN 9 THEN 'Quote Number' WHEN 10 THEN 'Item#' ELSE concat('Part ', CAST(p_size AS STRING)) END"""

HEADER_TEXT = f"CASE WHEN (floor(p_partkey / 48) + floor(p_partkey / 12) % 4 * 3 + (p_partkey % 12 + 1) * 5) % 4 = 0 THEN 'Remarks' ELSE {LABELS} END"
RATE_TEXT = """CASE p_partkey % 9 WHEN 0 THEN 'Labour' WHEN 1 THEN 'Our Rate $CAD/Hr now' WHEN 2 THEN 'Labour Rate:' WHEN 3 THEN 'Rate' WHEN 4 THEN 'Clip'
 ELSE concat('$', CAST(p_partkey % 40 + 10 AS STRING), '.25') END"""


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def norm_text(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", t.normalize_text(F.concat(F.lit("  "), "p_name", F.lit("  : ;"))).alias("norm"))


def clean_part_no(spark, sf):
    d = _t(spark, sf, "part").selectExpr("p_partkey", f"{PART_TEXT} AS raw")
    return d.select("p_partkey", t.clean_part_number(F.col("raw")).alias("part_number"), t.bracketed_drawing(F.col("raw")).alias("drawing_number"))


def clean_numbers(spark, sf):
    """Cycle time, operators, currency, weight and volume of every cell, and how many cells give them."""
    raw = F.col("raw")
    d = _t(spark, sf, "lineitem").selectExpr(f"{CELL_TEXT} AS raw").groupBy("raw").agg(F.count("*").alias("n"))  # a text gives the same wherever it stands
    return d.select(
        "raw", t.clean_cycle_time(raw).alias("cycle_time"), t.clean_ops(raw).alias("ops"),
        t.clean_currency(raw).alias("currency"), t.clean_weight(raw).alias("weight"), t.clean_volume(raw).alias("volume"), "n",
    )


def typed_numbers(spark, sf):
    """The cleaners on typed numbers of three decimals and either sign."""
    v = F.col("v")
    s = v.cast("string")
    return _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{TYPED} AS v").select(
        "l_orderkey", "l_linenumber", "l_partkey", "v", t.clean_cycle_time(s, v).alias("cycle_time"), t.clean_ops(s, v).alias("ops"),
        t.clean_currency(s, v).alias("currency"), t.clean_weight(s, v).alias("weight"), t.clean_volume(s, v).alias("volume"),
    )


def clean_texts(spark, sf):
    """Texts without their edges."""
    raw = "concat(CASE p_partkey % 5 WHEN 0 THEN 'Clip:' WHEN 1 THEN concat(' - ', p_name, ' ;') WHEN 2 THEN '#REF!' WHEN 3 THEN concat('a  b', p_size) ELSE '--' END, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END)"
    return _t(spark, sf, "part").selectExpr("p_partkey", f"{raw} AS raw").select("p_partkey", t.clean_text(F.col("raw")).alias("text"))


def coord_roundtrip(spark, sf):
    d = _t(spark, sf, "part").selectExpr("p_partkey", "CAST(p_partkey % 16384 + 1 AS INT) AS c", "p_size AS r")
    a = d.withColumn("coord", t.make_coord(F.col("r"), F.col("c")))
    return a.select("p_partkey", "coord", t.parse_coord(F.col("coord"))["col"].alias("col"), t.parse_coord(F.col("coord"))["row"].alias("row"))


def coord_split(spark, sf):
    raw = "CASE p_partkey % 3 WHEN 0 THEN concat('My Sheet!B', CAST(p_size AS STRING)) WHEN 1 THEN concat('C', CAST(p_size AS STRING)) ELSE ' ' END"
    s = t.split_coord(F.col("raw"))
    return _t(spark, sf, "part").selectExpr("p_partkey", f"{raw} AS raw").select("p_partkey", s["sheet"].alias("sheet"), s["cell"].alias("cell"))


def resolve_item_no(spark, sf):
    d = _t(spark, sf, "orders").selectExpr("o_orderkey", f"{QUOTE_TEXT} AS q", f"{ITEM_TEXT} AS i", "CAST(o_orderkey % 3 + 1 AS INT) AS seq")
    r = t.resolve_item_number(F.col("q"), F.col("i"), F.lit("Q9999"), F.col("seq"))
    return d.select("o_orderkey", r["number"].alias("quote_item_number"), r["warning"].alias("warning"))


def norm_part_no(spark, sf):
    return _t(spark, sf, "part").selectExpr("p_partkey", f"{PART_TEXT} AS raw").select("p_partkey", t.normalize_part_number(F.col("raw")).alias("key"))


def part_tokens(spark, sf):
    return _t(spark, sf, "part").selectExpr("p_partkey", f"{PART_TEXT} AS raw").select("p_partkey", F.explode(t.matching_tokens(F.col("raw"))).alias("token"))


def stop_words(spark, sf):
    raw = "concat(CASE p_partkey % 7 WHEN 0 THEN 'TOTAL' WHEN 1 THEN '* Notes:' WHEN 2 THEN 'Sub-Total' WHEN 3 THEN 'Grand Total' WHEN 4 THEN 'Revision-B' WHEN 5 THEN 'Totally' ELSE p_name END, CASE WHEN p_size % 2 = 0 THEN ' : ' ELSE '' END)"
    return _t(spark, sf, "part").selectExpr("p_partkey", f"{raw} AS raw").select("p_partkey", t.is_stop(F.col("raw")).alias("stops"))


def _items(spark, sf):
    return _t(spark, sf, "lineitem").selectExpr(*_split(ITEMS))


def _split(exprs: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in exprs:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def validate_conf(spark, sf):
    v = validate.validated(_items(spark, sf))
    return v.groupBy("confidence", F.size("warnings").alias("n_warnings")).agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey")).alias("keys"))


def overall_conf(spark, sf):
    v = validate.validated(_items(spark, sf))
    return v.groupBy("l_orderkey").agg(validate.worst(F.col("confidence")).alias("confidence"), F.count("*").alias("items"))


def sanity_summary(spark, sf):
    c = validate.sanity_cells(_items(spark, sf), ["l_orderkey"])
    return c.groupBy("field", "severity").agg(F.count("*").alias("n"))


def row_flags(spark, sf):
    c = validate.sanity_cells(_items(spark, sf), ["l_orderkey"])
    rank = F.when(F.col("severity") == "red", 2).when(F.col("severity") == "yellow", 1).otherwise(0)
    return c.groupBy("l_orderkey").agg(F.max(rank).alias("worst"), F.count_if(F.col("severity") == "red").alias("red"), F.count_if(F.col("severity") == "yellow").alias("yellow"))


def _doc_cells(spark, sf):
    """documents.text as sheets: lines are rows, words columns."""
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    words = lines.select("doc_id", (F.col("r") + 1).alias("row"), F.posexplode(F.split("line", " ")).alias("c", "v_str"))
    return words.filter("v_str <> ''").select("doc_id", "row", (F.col("c") + 1).alias("col"), "v_str")


def sheet_extent(spark, sf):
    return cells.extent(_doc_cells(spark, sf), ["doc_id"])


def _label_cells(spark, sf):
    """part and supplier keys as sheets of 40 cells: labels in odd columns, values between."""
    return _t(spark, sf, "part").selectExpr(
        "CAST(p_partkey % 50 AS BIGINT) AS sheet", "CAST(p_partkey AS BIGINT) AS ord", "CAST(p_partkey / 50 % 20 + 1 AS INT) AS row",
        "CAST(1 + 3 * floor(p_partkey / 1000) AS INT) AS col", f"{LABELS} AS v_str",
    ).unionByName(_t(spark, sf, "part").selectExpr(
        "CAST(p_partkey % 50 AS BIGINT) AS sheet", "CAST(p_partkey + 1000000 AS BIGINT) AS ord", "CAST(p_partkey / 50 % 20 + 1 AS INT) AS row",
        "CAST(2 + 3 * floor(p_partkey / 1000) + p_partkey % 2 AS INT) AS col", "concat('v', CAST(p_partkey AS STRING)) AS v_str",
    ))


def anchor_best(spark, sf):
    c = _label_cells(spark, sf)
    found = cells.targets(cells.anchors(c, ANCHORS), c, ["sheet"])
    return cells.best_targets(found, ["sheet"], F.when(F.col("value").startswith("v"), F.col("value"))).select(
        "sheet", "field", F.col("clean").alias("value"), "t_row", "t_col"
    )


def merged_targets(spark, sf):
    """The value beside each label where every pair of columns behind a label is one merged range."""
    c = _label_cells(spark, sf)
    m = _t(spark, sf, "part").selectExpr(
        "CAST(p_partkey % 50 AS BIGINT) AS sheet", "CAST(p_partkey / 50 % 20 + 1 AS INT) AS min_row", "CAST(p_partkey / 50 % 20 + 1 AS INT) AS max_row",
        "CAST(2 + 3 * floor(p_partkey / 1000) AS INT) AS min_col", "CAST(3 + 3 * floor(p_partkey / 1000) AS INT) AS max_col",
    ).distinct()
    found = cells.targets(cells.anchors(c, ANCHORS), c, ["sheet"], merges=m)
    return found.groupBy("sheet", "field", "row", "col", "ord", "try_no").agg(F.min(F.struct("value", "t_row", "t_col")).alias("t")).select("sheet", "field", "row", "col", "ord", "try_no", "t.*")


def merged_cells(spark, sf):
    c = _label_cells(spark, sf)
    m = _t(spark, sf, "part").selectExpr(
        "CAST(p_partkey % 50 AS BIGINT) AS sheet", "CAST(p_partkey AS BIGINT) AS merge_ord", "CAST(p_partkey / 50 % 20 + 1 AS INT) AS min_row",
        "CAST(p_partkey / 50 % 20 + 2 AS INT) AS max_row", "CAST(p_size % 4 + 1 AS INT) AS min_col", "CAST(p_size % 4 + 3 AS INT) AS max_col",
    )
    return cells.in_merged(c.select("sheet", "row", "col").distinct(), m, ["sheet"])


def labour_rate(spark, sf):
    """The rate of each sheet of twelve cells, by its labels."""
    c = _t(spark, sf, "part").selectExpr(
        "CAST(floor(p_partkey / 12) AS BIGINT) AS sheet", "CAST(p_partkey AS BIGINT) AS ord", "CAST(floor(p_partkey / 3) % 4 + 1 AS INT) AS row", "CAST(p_partkey % 3 + 1 AS INT) AS col", f"{RATE_TEXT} AS v_str",
    )
    return cells.rates(c, RATE_ANCHORS, ["sheet"])


def header_classify(spark, sf):
    d = _t(spark, sf, "part").selectExpr("p_partkey", f"{LABELS} AS raw")
    cats = grid.header_categories(t.normalize_text(F.col("raw")))
    return d.select("p_partkey", F.concat_ws(",", cats).alias("categories"))


def _header_cells(spark, sf):
    return _t(spark, sf, "part").selectExpr(
        "CAST(floor(p_partkey / 48) AS BIGINT) AS sheet", "CAST(floor(p_partkey / 12) % 4 AS INT) AS row", "CAST(p_partkey % 12 + 1 AS INT) AS col", f"{HEADER_TEXT} AS raw"
    ).withColumn("norm", t.normalize_text(F.col("raw")))


def header_pick(spark, sf):
    return grid.best_header(grid.header_slots(_header_cells(spark, sf), ["sheet"]), ["sheet"]).select("sheet", "header_row", "score")


def index_rows(spark, sf):
    value = "CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber ELSE l_quantity END AS INT)"
    d = _t(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS sheet", "l_suppkey AS row", "l_linenumber AS col", f"CASE WHEN l_linenumber = 1 AND l_suppkey % 5 = 0 THEN 'No.' ELSE CAST({value} AS STRING) END AS v_str",
        f"CAST(CASE WHEN l_orderkey % 3 > 0 AND NOT (l_linenumber = 1 AND l_suppkey % 5 = 0) THEN {value} END AS DOUBLE) AS v_num",
    )
    return grid.index_rows(d.distinct(), ["sheet"])


def _walk_rows(spark, sf):
    return _t(spark, sf, "events").selectExpr(
        "user_id AS sheet", "ts AS row", "event_id", "event_type = 'error' AND event_id % 5 = 0 AS is_stop", "event_type = 'signup' AND event_id % 3 = 0 AS is_empty",
        "event_type = 'view' AND event_id % 4 = 0 AS is_idx", "event_type <> 'click' OR event_id % 3 = 0 AS has_info", "event_type <> 'click' AND event_id % 6 <> 0 AS has_part",
    )


def row_walk(spark, sf):
    return grid.row_walk(_walk_rows(spark, sf), ["sheet"]).select("sheet", "event_id", "item_seq")


def pivot_slots(spark, sf):
    """Each table's rows below the header, one column for each header class."""
    h = grid.best_header(grid.header_slots(_header_cells(spark, sf), ["sheet"]), ["sheet"])
    body = _header_cells(spark, sf).select("sheet", (F.col("row") + 10).alias("row"), "col", F.concat("raw", F.lit("!")).alias("v_str"), F.lit(None).cast("double").alias("v_num"))
    return grid.pivot_slots(body, h, ["sheet"]).select("sheet", "row", "part_specific", "cycle_time", "quote")


def dedupe_first(spark, sf):
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return cells.keep_first(d, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


def _sheets(spark, sf):
    return _t(spark, sf, "part").selectExpr(
        "CAST(floor(p_partkey / 5) AS BIGINT) AS book", "CAST(p_partkey % 5 AS INT) AS sheet_idx", f"{TITLE} AS title",
        "CASE WHEN p_size % 6 = 0 THEN 'hidden' ELSE 'visible' END AS state", "CAST(p_size % 4 AS INT) AS n_cells", "p_size % 3 = 0 AS has_cycle",
    ).withColumn("norm", F.lower(F.trim("title")))


def tab_numbers(spark, sf):
    """The item number of each sheet that stands for one item."""
    d = _sheets(spark, sf).selectExpr(
        "*", "CASE WHEN sheet_idx = 1 THEN concat('Q', 2000 + book, '-R1-', n_cells) WHEN sheet_idx = 2 THEN concat('Q', 3000 + book) END AS found",
        "CASE WHEN book % 3 > 0 THEN concat('Q', 1000 + book) END AS base", "sheet_idx + 1 AS place",
    )
    return d.select("book", "sheet_idx", sheets.tab_number(F.col("title"), F.col("found"), F.col("base"), F.col("place")).alias("quote_item_number"))


def sheet_rank(spark, sf):
    return sheets.ranked(_sheets(spark, sf), ["book"], sheets.mpc_score(F.col("norm"))).select("book", "sheet_idx", F.col("score").cast("int").alias("score"), "rank")


def candidate_sheets(spark, sf):
    return sheets.candidates(_sheets(spark, sf), ["book"]).select("book", "sheet_idx", "title")


def _quotes(spark, sf):
    return _t(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS quote_ord", f"{PART_TEXT} AS part_number", "CASE WHEN p_partkey % 3 = 0 THEN concat('DRW', CAST(p_partkey AS STRING), 'X') ELSE '' END AS drawing_number")


JOB_PART = """CASE l_linenumber % 6 WHEN 0 THEN concat('22020', CAST(l_partkey AS STRING)) WHEN 1 THEN concat('3042', CAST(l_partkey AS STRING), 'c (dwg 40-a)')
 WHEN 2 THEN concat('p09', CAST(l_partkey AS STRING)) WHEN 3 THEN concat('drw', CAST(l_partkey AS STRING), 'x') WHEN 4 THEN concat('PN-', CAST(l_partkey AS STRING)) ELSE concat('none ', CAST(l_partkey AS STRING)) END"""


def _jobs(spark, sf):
    """Distinct job texts of lineitem, numbered by part and text."""
    d = _t(spark, sf, "lineitem").selectExpr("l_partkey", f"{JOB_PART} AS part_number").distinct()
    return d.selectExpr("concat(CAST(l_partkey AS STRING), '/', part_number) AS job_ord", "concat('J', CAST(l_partkey AS STRING)) AS job_number", "part_number")


def link_tiers(spark, sf):
    return link.match_tiers(_jobs(spark, sf), _quotes(spark, sf)).select("job_ord", "tier", "key")


def link_jobs(spark, sf):
    return link.link(_jobs(spark, sf), _quotes(spark, sf)).select("job_ord", "status", "match_type", "confidence", "quote_ord")


def unlinked_quotes(spark, sf):
    q = _quotes(spark, sf)
    return link.unlinked(q, link.link(_jobs(spark, sf), q)).select("quote_ord", "part_number")


def link_summary(spark, sf):
    q = _quotes(spark, sf)
    return link.summary(link.link(_jobs(spark, sf), q), q)


def flat_rows(spark, sf):
    v = validate.validated(_items(spark, sf))
    f = documents.flat_rows(v)
    return f.groupBy("warnings", "confidence", "material").agg(F.count("*").alias("n"))


def frame_rows(spark, sf):
    """All export columns but the texts of warnings, in the order of frames."""
    return documents.frame(validate.validated(_items(spark, sf))).drop("warnings")


def key_figures(spark, sf):
    v = validate.validated(_items(spark, sf)).withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "weight_g"))
    return documents.key_figures(v, ["l_orderkey"], "o")


def doc_roundtrip(spark, sf):
    """Items to document texts and back."""
    i = _items(spark, sf)
    docs = sinks.documents_json(i, ["l_orderkey"], "l_linenumber")
    return sinks.document_items(sinks.read_documents(docs, sinks.document_schema(i, ["l_orderkey"])), ["l_orderkey"])


def doc_totals(spark, sf):
    i = _items(spark, sf).withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "weight_g"))
    return documents.totals(i, ["l_orderkey"], "o")


def job_text_parse(spark, sf):
    raw = """CASE o_orderkey % 5 WHEN 0 THEN concat('J', CAST(o_orderkey AS STRING), ',', 'P', CAST(o_custkey AS STRING)) WHEN 1 THEN concat('J', CAST(o_orderkey AS STRING), ';P', CAST(o_custkey AS STRING))
 WHEN 2 THEN concat(' J', CAST(o_orderkey AS STRING), ' | P', CAST(o_custkey AS STRING)) WHEN 3 THEN concat('J', CAST(o_orderkey AS STRING)) ELSE concat('J', CAST(o_orderkey AS STRING), '   P', CAST(o_custkey AS STRING)) END"""
    d = _t(spark, sf, "orders").selectExpr("1 AS job_text_id", "CAST(o_orderkey AS BIGINT) AS line_no", f"{raw} AS line")
    return parse_job_text(d).select("line_no", "job_number", "part_number")


def run_metrics(spark, sf):
    v = validate.validated(_items(spark, sf))
    d = v.groupBy("l_orderkey").agg(F.count("*").alias("total_items"), F.sum(F.size("warnings")).alias("n_warnings")).withColumn("failed", F.col("l_orderkey") % 97 == 0)
    return documents.run_metrics(d)


def contract_values(spark, sf):
    """The record's readings of each text, which differ from those of cells."""
    raw = F.col("raw")
    d = _t(spark, sf, "lineitem").selectExpr(f"{CELL_TEXT} AS raw")
    d = d.select("raw", *(validate.contract_number(f, raw).alias(f) for f in ("cycle_time_sec", "ops_labour", "labour_rate", "weight_g")))
    return d.groupBy(*d.columns).agg(F.count("*").alias("n"))


def target_sheets(spark, sf):
    d = _t(spark, sf, "part").selectExpr("p_partkey", f"CASE p_partkey % 4 WHEN 0 THEN concat('old_', p_partkey % 9, '_mpc') WHEN 1 THEN p_name ELSE {TITLE} END AS title")
    return d.select("p_partkey", "title", sheets.is_target(F.col("title")).alias("is_target"))


def _shown_items(spark, sf):
    return _items(spark, sf).withColumns({
        "confidence": F.lit("low"), "warnings": F.array(F.lit("a"), F.col("material")),
        "part_num_coord": F.concat(F.lit("B"), F.col("l_linenumber").cast("string")), "quote_num_coord": F.when(F.col("l_linenumber") % 2 == 0, F.lit("S!A1")),
        **{f"{n}_coord": F.lit(None).cast("string") for n in display.COORD_TAGS if n not in ("part_num", "quote_num")},
    })


def display_rows(spark, sf):
    """Display rows by item text, and how often each stands."""
    d = display.display_rows(_shown_items(spark, sf), coords=True)
    return d.groupBy(F.col("Description").alias("description"), F.col("Material").alias("material"), F.col("Cell Coordinates").alias("coords"), F.col("Warnings").alias("warnings")).agg(F.count("*").alias("n"))


def coords_parse(spark, sf):
    """The sheet-less coordinates of the text that was written from them."""
    c = display.parse_coords(F.col("s"))
    d = _shown_items(spark, sf).select("l_linenumber", display.coords_text().alias("s"))
    return d.groupBy("l_linenumber", c["quote_num"].alias("quote_num"), c["part_num"].alias("part_num"), c["weight_g"].alias("weight_g")).agg(F.count("*").alias("n"))


def number_formats(spark, sf):
    d = _t(spark, sf, "orders")
    return d.select(
        "o_orderkey", display.formatted("labour_rate", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") / 4)).alias("rate"),
        display.formatted("weight_g", F.col("o_custkey") / 8 * 2).alias("weight"), display.formatted("annual_volume", F.col("o_orderkey") * 1000).alias("volume"),
    )


def canonical_items(spark, sf):
    """Edited rows named, rounded and split again."""
    d = _t(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat(' Q', o_orderkey, '-1') END AS `Quote Item`", "'PN 1 ' AS `Part Number`", "'' AS Description",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'PA66' END AS Material", "concat(o_orderkey % 50, '.25') AS `Cycle Sec`", "'x' AS `#Ops`", "'1.5' AS `Labour Rate ($CAD/Hr)`", "'2' AS `Weight (g)`",
        "CAST(o_orderkey % 9 AS STRING) AS `Ann. Volume (EAU)`", "CASE WHEN o_orderkey % 2 = 0 THEN ' High' ELSE 'odd' END AS Confidence", "'a; b ;;' AS Warnings",
    )
    c = display.canonical(d, ["o_custkey", "o_orderkey"], "o_orderkey", F.concat(F.lit("Q"), F.col("o_custkey").cast("string")))
    return c.select("o_orderkey", "quote_item_number", "part_number", "description", "material", "cycle_time_sec", "ops_labour", "annual_volume", "confidence", F.concat_ws("|", "warnings").alias("warnings"))


def _described_quotes(spark, sf):
    return _quotes(spark, sf).selectExpr(
        "*", "concat('Q', quote_ord) AS quote_item_number", "'Clip' AS description", "CAST(NULL AS STRING) AS material", "CAST(quote_ord AS DOUBLE) AS cycle_time_sec",
        "0.5D AS ops_labour", "48.5D AS labour_rate", "CAST(NULL AS DOUBLE) AS weight_g", "quote_ord * 10 AS annual_volume", "'high' AS confidence",
    )


def linked_rows(spark, sf):
    q = _described_quotes(spark, sf)
    rows = display.linked_rows(link.link(_jobs(spark, sf), q.select("quote_ord", "part_number", "drawing_number")), q.drop("drawing_number", "confidence"))
    return rows.select("job_ord", F.col("Part Number").alias("part"), F.col("Quote Item").alias("item"), F.col("Cycle Sec").alias("cycle"), F.col("Link Status").alias("status"), F.col("Match Confidence").alias("confidence"))


def header_data(spark, sf):
    """How many rows of data stand below each possible header."""
    c = _header_cells(spark, sf)
    h = grid.header_slots(c, ["sheet"]).filter(grid.is_header(F.col("slots")))
    body = c.select("sheet", (F.col("row") * 2 + 3).alias("row"), "col", F.concat(F.when(F.col("col") % 5 == 0, F.lit("Q1234-")).otherwise(F.lit("")), F.col("sheet").cast("string"), F.lit("0")).alias("v_str")).withColumn("v_num", F.col("v_str").try_cast("double"))
    return grid.data_rows(body, h, ["sheet"]).select("sheet", "row", "n_data")


def queries():
    every = (
        norm_text, clean_part_no, clean_numbers, typed_numbers, clean_texts, coord_roundtrip, coord_split, resolve_item_no, norm_part_no, part_tokens,
        stop_words, validate_conf, overall_conf, sanity_summary, row_flags, sheet_extent, anchor_best, merged_targets, merged_cells,
        labour_rate, header_classify, header_pick, index_rows, row_walk, pivot_slots, dedupe_first, sheet_rank, candidate_sheets, tab_numbers,
        link_tiers, link_jobs, unlinked_quotes, link_summary, flat_rows, frame_rows, key_figures, doc_roundtrip, doc_totals, job_text_parse, run_metrics,
        contract_values, target_sheets, display_rows, coords_parse, number_formats, canonical_items, linked_rows, header_data,
    )
    return {f.__name__: f for f in every}
