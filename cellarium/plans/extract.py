"""From workbooks to quote items: tables and forms, end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.constants import CYCLE_MENTIONS, DRAWING_ANCHORS, ERRORS, EXPORT_COLUMNS, GRADE_ANCHORS, OFFSETS
from ..operators import cells as cell_ops
from ..operators import grid, sheets as sheet_ops, validate
from ..operators.durable import held as _held
from ..sources import workbook
from .config import Config

KEYS = ["doc_id", "sheet_idx"]
COORDS = {"part_number": "part_num"}


_CLEAN = {
    "part_number": t.clean_part_value, "cycle_time": t.clean_cycle_time, "description": lambda s, n: t.clean_text(s),
    "material": lambda s, n: t.clean_text(s), "material_grade": lambda s, n: t.clean_text(s), "drawing_number": lambda s, n: t.clean_text(s), "ops_labour": t.clean_ops, "labour_rate": t.clean_currency,
    "weight_g": t.clean_weight, "annual_volume": t.clean_volume,
}
_OUT = ["part_number", "description", "material", "cycle_time_sec", "ops_labour", "labour_rate", "weight_g", "annual_volume"]


def _typed(c: str, name: str):
    kind = {"annual_volume": "long"}.get(name, "double") if name in ("cycle_time_sec", "ops_labour", "labour_rate", "weight_g", "annual_volume") else "string"
    return F.col(c).cast(kind).alias(name)


def _norm_title(title: str = "title") -> Column:
    return F.lower(F.trim(title))


def candidate_sheets(facts: DataFrame, config: Config = Config()) -> DataFrame:
    """The sheets of each workbook to read: keys, title, is_multi (the workbook has several sheets), n_tabs
    (how many sheets are candidates; 0: none is, and all visible sheets stand in for them)."""
    cells = workbook.cells(facts)
    low = F.lower(F.col("v_str"))
    near = (F.col("row") <= 60) & (F.col("col") <= 50)
    stats = cells.groupBy(*KEYS).agg(
        F.count("*").cast("int").alias("n_cells"), F.coalesce(F.bool_or(near & t.any_of(low.contains(w) for w in CYCLE_MENTIONS)), F.lit(False)).alias("has_cycle")
    )
    every = workbook.sheets(facts).join(stats, KEYS, "left").fillna({"n_cells": 0, "has_cycle": False}).withColumn("norm", _norm_title())
    own = sheet_ops.candidates(every, ["doc_id"], config.ignored_sheets)
    seen = sheet_ops.is_visible(F.col("state"))
    none = every.join(own.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("seen", seen)
    w = Window.partitionBy("doc_id")
    rest = none.withColumns({"any": F.max("seen").over(w), "first": F.min("sheet_idx").over(w)}).filter("if(any, seen, sheet_idx = first)")
    number = every.groupBy("doc_id").agg((F.count("*") > 1).alias("is_multi"))
    tabs = own.groupBy("doc_id").agg(F.count("*").alias("n_tabs"))
    picked = own.select(*KEYS, "title").unionByName(rest.select(*KEYS, "title"))
    return picked.join(number, "doc_id").join(tabs, "doc_id", "left").fillna(0, ["n_tabs"])


def _table_rows(facts: DataFrame, where: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows below the headers, headers) of the sheets ``where`` (keys) that hold a table."""
    cells = workbook.cells(facts).join(where, KEYS).filter("trim(v_str) <> ''")
    hidden = facts.filter("kind = 'hidden'").select(*KEYS, "row").distinct()
    shown = cells.join(hidden, [*KEYS, "row"], "left_anti")
    top = shown.filter("row <= 175 and col < 60")
    slots = grid.header_slots(top.filter("row <= 150").withColumn("norm", t.normalize_text(F.col("v_str"))), KEYS).filter(grid.is_header(F.col("slots")))
    slots = _held(slots)
    headers = _held(grid.best_header(slots, KEYS, grid.data_rows(top, slots, KEYS, hidden)))
    index = grid.index_rows(shown.select(*KEYS, "row", "col", "v_str", "v_num"), KEYS).withColumn("is_idx", F.lit(True))
    wide = grid.pivot_slots(shown, headers, KEYS)
    stops = shown.groupBy(*KEYS, "row").agg(F.bool_or(t.is_stop(F.col("v_str"))).alias("is_stop"))
    last = shown.groupBy(*KEYS).agg(F.max("row").alias("max_row"))
    rows = headers.join(last, KEYS).filter("max_row > header_row").withColumn("row", F.explode(F.sequence(F.col("header_row") + 1, F.col("max_row"))))
    rows = rows.join(hidden, [*KEYS, "row"], "left_anti").join(wide, [*KEYS, "row"], "left").join(stops, [*KEYS, "row"], "left").join(index, [*KEYS, "row"], "left")
    raw = F.coalesce("part_specific", "part_generic")
    return _held(rows.withColumns({"raw_part": raw, "pn": t.clean_part_value(raw, F.col("part_num")), "ct": t.clean_cycle_time(F.col("cycle_time"))})), headers


def closest(facts: DataFrame, score, config: Config = Config()) -> DataFrame:
    """(doc_id, sheet_idx): each workbook's visible, not ignored sheet of greatest score."""
    every = workbook.sheets(facts).withColumn("norm", _norm_title())
    seen = every.filter(sheet_ops.is_visible(F.col("state")) & ~sheet_ops.is_ignored(F.col("norm"), config.ignored_sheets))
    return sheet_ops.ranked(seen, ["doc_id"], score(F.col("norm"))).filter("rank = 1").select(*KEYS)


def grid_items(facts: DataFrame, picked: DataFrame, base: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(items of sheets that hold a table, those sheets with their headers).

    Rows without part number, and parts without item number, are mended from the closest
    quote-information sheet where that is another sheet with a table. A row can be mended by place
    while its place is within that table, so the places of rows are known before any is mended;
    beyond it a row is mended by its number alone.
    """
    info = closest(facts, sheet_ops.qinfo_score, config)
    rows, headers = _table_rows(facts, picked.select(*KEYS).unionByName(info).distinct())
    rows = rows.join(base, "doc_id", "left")
    number = lambda seq: t.resolve_item_number(F.coalesce("quote", F.lit("")), F.coalesce("item", F.lit("")), F.col("base_id"), seq)
    has = lambda n: F.map_contains_key(F.col("slots"), F.lit(n))
    place = Window.partitionBy("doc_id").orderBy("row")
    known = rows.join(info, KEYS, "left_semi").filter("pn is not null").withColumn("idx", F.row_number().over(place))
    known = known.withColumn("number", F.when(has("item") | has("quote"), number(F.col("idx"))["number"])).select("doc_id", "sheet_idx", "idx", "pn", "number")
    lookups = _held(grid.part_lookups(_held(known), KEYS).withColumnsRenamed({"doc_id": "info_doc", "sheet_idx": "info_idx"}))

    rows = rows.join(picked.select(*KEYS, "title", "is_multi"), KEYS)
    rows = rows.join(lookups, F.expr("doc_id = info_doc and sheet_idx <> info_idx"), "left")
    rows = rows.withColumns({
        "is_empty": F.col("is_stop").isNull(), "is_stop": F.coalesce("is_stop", F.lit(False)), "is_idx": F.coalesce("is_idx", F.lit(False)),
        "has_info": F.col("pn").isNotNull() | F.col("ct").isNotNull(),
    })
    down = Window.partitionBy(*KEYS).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    live = F.col("has_info") & ~F.col("is_stop") & ~F.col("is_empty")
    could = live & ~F.col("is_idx") & (F.col("pn").isNotNull() | F.col("n_rows").isNotNull())
    rows = rows.withColumn("begun", F.max(could.cast("int")).over(down) == 1)
    rows = rows.withColumn("at", F.sum((live & (F.col("begun") | ~F.col("is_idx"))).cast("int")).over(down))
    rows = _held(rows.withColumn("at_number", number(F.col("at"))["number"]))
    part, _ = grid.repaired(F.col("pn"), F.col("at_number"), F.col("at"), F.col("quote"), F.col("item"))
    rows = rows.withColumn("mended", F.when(F.col("has_info"), part)).withColumn("has_part", F.col("mended").isNotNull())
    kept = _held(grid.row_walk(_held(rows), KEYS).withColumn("no", number(F.col("item_seq"))))
    no = F.col("no")
    _, item_number = grid.repaired(F.col("pn"), no["number"], F.col("item_seq"), F.col("quote"), F.col("item"))
    values = {
        "description": t.clean_text(F.col("description")), "material": t.clean_text(F.coalesce("material_grade", "material_generic")),
        "cycle_time_sec": F.col("ct"), "ops_labour": t.clean_ops(F.col("ops")), "labour_rate": F.col("rate"),
        "weight_g": t.clean_weight(F.col("weight")), "annual_volume": t.clean_volume(F.col("volume")),
    }
    kept = _held(kept.join(sheet_rates(facts, picked, config), KEYS, "left").withColumn("value", F.struct(*(v.alias(n) for n, v in values.items()))))
    values = {n: F.col("value")[n] for n in values}
    wide = F.exists(F.map_keys("slots"), lambda c: c.isin("description", "material_grade", "material_generic", "ops", "weight", "volume"))
    asked = wide | F.lower("title").rlike("mpc|qinfo|quote")
    missing = F.array_compact(F.array(*(F.when(asked & v.isNull(), F.lit(f"Missing {n}")) for n, v in values.items())))
    drawing = F.coalesce(t.clean_text(F.col("drawing")), t.bracketed_drawing(F.col("raw_part")))
    at = lambda *names: t.make_coord(F.col("row"), F.coalesce(*(F.col("slots")[n] for n in names)))
    coords = {
        "quote_num": F.coalesce(at("quote"), at("item"), t.make_coord(F.col("row"), F.lit(1))), "part_num": at("part_specific", "part_generic"),
        "description": at("description"), "material": at("material_grade", "material_generic"), "cycle_time": at("cycle_time"),
        "ops_labour": at("ops"), "labour_rate": F.col("rate_coord"), "weight_g": at("weight"), "annual_volume": at("volume"),
    }
    items = kept.select(
        *KEYS, F.col("row").cast("long").alias("seq"), item_number.alias("quote_item_number"), F.col("mended").alias("part_number"), drawing.alias("drawing_number"),
        *(v.alias(n) for n, v in values.items()), F.concat(F.array_compact(F.array(no["warning"])), missing).alias("warnings"),
        *(_placed(c).alias(f"{n}_coord") for n, c in coords.items()),
    )
    return items, headers.select(*KEYS)


def _placed(coord: Column) -> Column:
    """The coordinate behind its sheet's title, in workbooks of several sheets; null stays null."""
    return F.when(coord.isNotNull(), F.when(F.col("is_multi"), F.concat_ws("!", F.when(~coord.contains("!"), F.col("title")), coord)).otherwise(coord))


def labour_rates(facts: DataFrame, config: Config = Config()) -> DataFrame:
    """(keys, rate, rate_coord): the rate below, or right of, its label on each sheet."""
    best = cell_ops.rates(workbook.cells(facts), config.anchors["labour_rate"], KEYS)
    return best.select(*KEYS, "rate", t.make_coord(F.col("t_row"), F.col("t_col")).alias("rate_coord"))


def sheet_rates(facts: DataFrame, picked: DataFrame, config: Config = Config()) -> DataFrame:
    """(keys, rate, rate_coord) for each picked sheet: its own, else the closest MPC sheet's, else that of
    the first other sheet that is visible and not ignored."""
    shown = workbook.sheets(facts).withColumn("norm", _norm_title())
    usable = sheet_ops.is_visible(F.col("state")) & ~sheet_ops.is_ignored(F.col("norm"), config.ignored_sheets)
    rates = labour_rates(facts, config).join(shown.select(*KEYS, F.col("title").alias("rate_title"), usable.alias("usable")), KEYS)
    rates = rates.join(closest(facts, sheet_ops.mpc_score, config).withColumn("is_mpc", F.lit(True)), KEYS, "left").withColumnRenamed("sheet_idx", "rate_idx")
    own = F.col("rate_idx") == F.col("sheet_idx")
    level = F.when(own, 0).when(F.col("is_mpc"), 1).when(F.col("usable"), 2)
    coord = F.when(own, F.col("rate_coord")).otherwise(F.concat_ws("!", "rate_title", "rate_coord"))
    tried = picked.select(*KEYS).join(rates, "doc_id").withColumn("level", level).filter("level is not null")
    best = F.min_by(F.struct(F.col("rate"), coord.alias("rate_coord")), F.struct("level", "rate_idx"))
    return tried.groupBy(*KEYS).agg(best.alias("r")).select(*KEYS, "r.rate", "r.rate_coord")


_ITEM_ID, _BASE_ID = r"(?i)\b(Q[0-9]{4,5}-[0-9]+)\b", r"(?i)\b(Q[0-9]{4,5})\b"


def sheet_quotes(facts: DataFrame, where: DataFrame, config: Config = Config()) -> DataFrame:
    """(keys, found, coord) of the sheets ``where`` (keys, title) that name a quote: an item number or a quote
    number in the title; the first cell with an item number; what stands beside a quote label; the
    first cell with a quote number."""
    value = lambda c, p: F.upper(F.nullif(F.regexp_extract(c, p, 1), F.lit("")))
    cells = workbook.cells(facts).join(where.select(*KEYS), KEYS)
    top = cells.filter("row < 150 and col < 20")
    hits = top.withColumns({"item": value("v_str", _ITEM_ID), "base": value("v_str", _BASE_ID)}).filter("base is not null")
    spot = t.make_coord(F.col("row"), F.col("col"))
    of_cells = hits.select(*KEYS, F.when(F.col("item").isNotNull(), 2).otherwise(4).alias("level"), "ord", F.lit(0).alias("try_no"), F.coalesce("item", "base").alias("found"), spot.alias("coord"))
    labels = cell_ops.anchors(top, {"quote": config.anchors["quote"]}, rows=149, cols=19)
    beside = cell_ops.targets(labels, cells, KEYS, OFFSETS, workbook.merges(facts)).withColumn("found", F.coalesce(value("value", _ITEM_ID), value("value", _BASE_ID)))
    of_labels = beside.filter("found is not null").select(*KEYS, F.lit(3).alias("level"), "ord", "try_no", "found", t.make_coord(F.col("t_row"), F.col("t_col")).alias("coord"))
    titled = where.withColumns({"item": value("title", _ITEM_ID), "base": value("title", _BASE_ID)}).filter("base is not null")
    of_titles = titled.select(
        *KEYS, F.when(F.col("item").isNotNull(), 0).otherwise(1).alias("level"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("try_no"),
        F.coalesce("item", "base").alias("found"), F.lit(None).cast("string").alias("coord"),
    )
    every = of_cells.unionByName(of_labels).unionByName(of_titles)
    return every.groupBy(*KEYS).agg(F.min_by(F.struct("found", "coord"), F.struct("level", "ord", "try_no")).alias("q")).select(*KEYS, "q.found", "q.coord")


def quote_ids(facts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, base_id): the quote of the first sheet that names one, else that of the file name."""
    name = F.element_at(F.split("doc_id", "/"), -1)
    base = quotes.withColumn("base", F.regexp_extract("found", r"\b(Q[0-9]{4,5})\b", 1)).filter("base <> ''")
    first = base.groupBy("doc_id").agg(F.min_by("base", "sheet_idx").alias("cell_id"))
    docs = facts.select("doc_id").distinct().join(first, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("cell_id", F.upper(F.nullif(F.regexp_extract(name, _BASE_ID, 1), F.lit("")))).alias("base_id"))


def form_items(facts: DataFrame, picked: DataFrame, tables: DataFrame, quotes: DataFrame, base: DataFrame, config: Config = Config()) -> DataFrame:
    """Items of candidate sheets without a table.

    Of several candidates each sheet with a quote number, a part number or a cycle time is an item; a
    workbook with one, or with none and its visible sheets instead, has one item: that of the first
    sheet with a part number or a cycle time, else with a quote number.
    """
    own = picked.join(tables, KEYS, "left_anti")
    cells = workbook.cells(facts).join(own.select(*KEYS), KEYS)
    words = {k: v for k, v in config.anchors.items() if k in _CLEAN and k != "labour_rate"} | {"drawing_number": DRAWING_ANCHORS, "material_grade": GRADE_ANCHORS}
    found = cell_ops.targets(cell_ops.anchors(cells, words), cells, KEYS, OFFSETS, workbook.merges(facts), inline=True)
    no_part = t.is_drawing_value(F.col("value")) | ((F.col("try_no") > 0) & cell_ops.is_other_label(t.normalize_text(F.col("value"))))
    found = found.filter(~((F.col("field") == "part_number") & no_part))
    clean = F.coalesce(*(F.when(F.col("field") == f, fn(F.col("value"), F.col("value_num")).cast("string")) for f, fn in _CLEAN.items() if f in words))
    best = cell_ops.best_targets(found, KEYS, clean, blank=(F.col("field") == "cycle_time") & F.trim("value").isin(*ERRORS))
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    coord = lambda f: F.max(F.when(F.col("field") == f, t.make_coord(F.col("t_row"), F.col("t_col"))))
    wide = _held(best).groupBy(*KEYS).agg(*(pick(f, "clean").alias(f) for f in words), *(coord(f).alias(f"{COORDS.get(f, f)}_coord") for f in words if f != "drawing_number"))
    graded = F.col("material_grade").isNotNull()
    wide = wide.withColumn("material_coord", F.when(graded, F.col("material_grade_coord")).otherwise(F.col("material_coord")))
    wide = wide.withColumn("material", F.coalesce("material_grade", "material")).withColumnRenamed("cycle_time", "cycle_time_sec")
    rows = own.join(wide, KEYS, "left").join(quotes.withColumnRenamed("coord", "quote_num_coord"), KEYS, "left").join(base, "doc_id", "left")
    rows = rows.join(labour_rates(facts, config), KEYS, "left").withColumnsRenamed({"rate": "labour_rate", "rate_coord": "labour_rate_coord"})
    anchored = F.col("part_number").isNotNull() | F.col("cycle_time_sec").isNotNull()
    rows = rows.withColumn("level", F.when(anchored, 0).when(F.col("found").isNotNull(), 1).otherwise(2))
    several = F.col("n_tabs") > 1
    best_one = F.min(F.struct("level", "sheet_idx")).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("best_one", best_one).filter(F.when(several, F.col("level") < 2).otherwise(
        (F.col("sheet_idx") == F.col("best_one.sheet_idx")) & ((F.col("level") < 2) | F.col("base_id").isNotNull())
    ))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_idx")))
    target = F.coalesce("found", "base_id")
    named = F.upper(F.nullif(F.regexp_extract(target, r"\b(Q[0-9]{4,5}(?:-[A-Za-z0-9]+)+)\b", 1), F.lit("")))
    quote = F.coalesce(F.nullif(F.regexp_extract(target, r"\b(Q[0-9]{4,5})\b", 1), F.lit("")), target)
    single = F.coalesce(named, F.concat(quote, F.lit("-1")), F.lit("Q0000-1"))
    number = F.when(several, sheet_ops.tab_number(F.col("title"), F.col("found"), F.col("base_id"), F.col("place"))).otherwise(single)
    inferred = F.when(target.isNotNull(), F.concat(F.lit("Inferred quote item number suffix '-1' from base quote "), quote)).otherwise("Inferred fallback quote item number 'Q0000-1'")
    drawing = F.coalesce("drawing_number", t.bracketed_drawing(F.col("part_number"))).alias("drawing_number")
    spots = [c for c in EXPORT_COLUMNS if c.endswith("_coord")]
    return rows.select(
        *KEYS, F.lit(0).cast("long").alias("seq"), number.alias("quote_item_number"), drawing, *(_typed(c, c) for c in _OUT),
        F.when(~several & named.isNull(), F.array(inferred)).otherwise(F.array().cast("array<string>")).alias("warnings"),
        *(_placed(F.coalesce(c, F.lit("B2")) if c == "quote_num_coord" else F.col(c)).alias(c) for c in spots),
    )


def extract(facts: DataFrame, config: Config = Config()) -> DataFrame:
    """Validated items of all workbooks; an item number stands once in a workbook (the first)."""
    picked = _held(candidate_sheets(facts, config))
    quotes = _held(sheet_quotes(facts, picked, config))
    base = _held(quote_ids(facts, quotes))
    if config.tables:
        tables, where = grid_items(facts, picked, base, config)
        items = tables.unionByName(form_items(facts, picked, where, quotes, base, config))
    else:
        items = form_items(facts, picked, picked.select(*KEYS).filter(F.lit(False)), quotes, base, config)
    first = cell_ops.keep_first(_held(items), ["doc_id", "quote_item_number"], ["sheet_idx", "seq"])
    done = validate.validated(first, config.least_cycle, config.most_cycle)
    return done.withColumn("source_file", F.element_at(F.split("doc_id", "/"), -1)).withColumn("quote_id", t.base_quote_id(F.col("quote_item_number"), F.lit(None)))


def documents(facts: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each workbook, those without items or unreadable too: doc_id, source_file, total_items,
    n_warnings, failed, warnings (of the workbook itself)."""
    own = facts.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "cell").alias("n_cells"), F.max(F.when((F.col("kind") == "error") & F.col("title").isNull(), F.col("v_str"))).alias("error")
    )
    found = items.groupBy("doc_id").agg(F.count("*").alias("total_items"), F.sum(F.size("warnings")).alias("item_warnings"))
    rows = own.join(found, "doc_id", "left").fillna(0, ["total_items", "item_warnings"])
    warning = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Extraction failed: "), "error"))
        .when(F.col("n_cells") == 0, "Workbook contains no populated worksheets.").when(F.col("total_items") == 0, "No quote items could be extracted from workbook.")
    )
    rows = rows.withColumn("warnings", F.array_compact(F.array(warning)))
    return rows.select(
        "doc_id", F.element_at(F.split("doc_id", "/"), -1).alias("source_file"), "total_items",
        (F.col("item_warnings") + F.size("warnings")).alias("n_warnings"), F.col("error").isNotNull().alias("failed"), "warnings",
    )


def extract_bytes(spark: SparkSession, content: bytes, name: str = "in_memory_quote.xlsx", config: Config = Config()) -> DataFrame:
    """The items of one workbook held in memory."""
    one = spark.createDataFrame([(name, content)], "path string, content binary")
    return extract(_held(workbook.facts(one)), config)


def extract_directory(spark: SparkSession, path: str, recursive: bool = True, config: Config = Config()) -> DataFrame:
    """The items of all workbooks of a folder, parsed once."""
    return extract(_held(workbook.facts(workbook.read_files(spark, path, recursive))), config)
