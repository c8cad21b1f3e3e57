"""Tables inside sheets: header classes and slots, header score, index rows, the row walk."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import HEADERS, INDEX_LABELS
from ..functions.text import any_of, clean_cycle_time, clean_part_value, is_stop, kw_match, normalize_text


def header_categories(norm: Column) -> Column:
    """array<string>: the classes of a header cell in slot precedence; a tool header has none."""
    is_ = {}
    for name, kws, out, _ in HEADERS:
        hit = kw_match(norm, *kws)
        is_[name] = hit & ~norm.rlike("|".join(out)) if out else hit
    tool = norm.rlike("|".join(re.escape(k) for k in HEADERS[0][1]))  # anywhere in the text
    bare = ~(is_["item"] | tool | is_["drawing"] | is_["description"])
    is_["part_specific"] = is_["part_specific"] & bare
    is_["part_generic"] = is_["part_generic"] & bare & ~is_["part_specific"]
    every = F.array_compact(F.array(*(F.when(is_[n], F.lit(n)) for n, _, _, _ in HEADERS[1:])))
    return F.when(tool, F.array().cast("array<string>")).otherwise(every)


def header_slots(cells: DataFrame, keys: list[str]) -> DataFrame:
    """For each row a map of class to column: cells from the left take their first class not yet taken."""
    own = cells.withColumn("cats", header_categories(F.col("norm"))).filter("size(cats) > 0")
    rows = own.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "cats"))).alias("cs"))
    empty = F.create_map().cast("map<string,int>")

    def take(m: Column, c: Column) -> Column:
        free = F.filter(c["cats"], lambda x: ~F.map_contains_key(m, x))
        return F.when(F.size(free) > 0, F.map_concat(m, F.create_map(F.get(free, F.lit(0)), c["col"].cast("int")))).otherwise(m)

    return rows.select(*keys, "row", F.aggregate("cs", empty, take).alias("slots"))


def header_score(slots: Column) -> Column:
    has = lambda *n: any_of(F.map_contains_key(slots, F.lit(x)) for x in n)
    point = {n: s for n, _, _, s in HEADERS}
    part = F.when(has("part_specific"), point["part_specific"]).when(has("part_generic"), point["part_generic"]).otherwise(0)
    material = F.when(has("material_grade", "material_generic"), 15).otherwise(0)
    rest = [F.when(has(n), point[n]).otherwise(0) for n in ("cycle_time", "description", "ops", "weight", "volume", "quote", "item", "drawing")]
    return sum(rest, part + material)


def is_header(slots: Column) -> Column:
    has = lambda *n: any_of(F.map_contains_key(slots, F.lit(x)) for x in n)
    return has("part_specific", "part_generic") & has("cycle_time", "quote", "item")


def data_rows(cells: DataFrame, headers: DataFrame, keys: list[str], hidden: DataFrame | None = None) -> DataFrame:
    """(keys, row, n_data): how many of the 25 rows below a possible header hold data, ten at most.

    Data is a part number of two characters, a quote id or a cycle time in the header's columns. The
    look ends at a stop word, at the fourth empty row in sequence, or at the second behind data.
    Hidden rows are passed over; so are rows that number the columns. cells: row, col, v_str, v_num.
    """
    filled = cells.filter("trim(v_str) <> ''")
    place = F.struct("col", F.struct("v_str", "v_num"))
    body = filled.groupBy(*keys, "row").agg(
        F.map_from_entries(F.collect_list(place)).alias("vals"), F.bool_or(is_stop(F.col("v_str"))).alias("stop")
    ).join(index_rows(filled, keys).withColumn("idx", F.lit(True)), [*keys, "row"], "left")
    ahead = headers.select(*keys, F.col("row").alias("header_row"), "slots", F.explode(F.sequence(F.col("row") + 1, F.col("row") + 25)).alias("row"))
    if hidden is not None:
        ahead = ahead.join(hidden, [*keys, "row"], "left_anti")
    at = lambda *names: F.col("vals")[F.coalesce(*(F.col("slots")[n] for n in names))]
    part = at("part_specific", "part_generic")
    no = F.lit(False)
    over = lambda *p: Window.partitionBy(*keys, "header_row", *p).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c, *p: F.sum(F.col(c).cast("int")).over(over(*p))
    rows = ahead.join(body, [*keys, "row"], "left").select(
        *keys, "header_row", "row", F.col("vals").isNull().alias("blank"), F.coalesce("idx", no).alias("idx"),
        (F.coalesce("stop", no) & ~F.coalesce("idx", no)).alias("stop"), part["v_str"].alias("raw_part"), part["v_num"].alias("raw_num"),
        at("quote")["v_str"].alias("raw_quote"), at("cycle_time")["v_str"].alias("raw_cycle"),
    ).withColumn("filled", ~F.col("blank")).withColumn("part", count("filled"))  # the cleaners stand behind a window: they read columns, not lookups
    seen = (
        (F.length(clean_part_value(F.col("raw_part"), F.col("raw_num"))) >= 2) | F.col("raw_quote").rlike(r"Q[0-9]{4,5}")
        | clean_cycle_time(F.col("raw_cycle")).isNotNull()
    )
    rows = rows.withColumn("data", ~F.col("idx") & ~F.col("stop") & F.coalesce(seen, no)).withColumn("found", count("data"))
    rows = rows.withColumn("blanks", count("blank", "part"))
    end = F.col("stop") | (F.col("blank") & ((F.col("blanks") >= 4) | ((F.col("found") > 0) & (F.col("blanks") >= 2))))
    rows = rows.withColumn("ended", F.max(end.cast("int")).over(over()))
    n = F.least(F.lit(10), F.count_if(F.col("data") & (F.col("ended") == 0))).cast("int")
    return rows.groupBy(*keys, F.col("header_row").alias("row")).agg(n.alias("n_data"))


def best_header(rows: DataFrame, keys: list[str], ahead: DataFrame | None = None) -> DataFrame:
    """The header row of greatest score (ties: the first), with its slots.

    ``ahead`` (keys, row, n_data) adds 50 for each row of data below.
    """
    scored = rows.filter(is_header(F.col("slots"))).withColumn("score", header_score(F.col("slots")))
    if ahead is not None:
        scored = scored.join(ahead, [*keys, "row"], "left").withColumn("score", F.col("score") + 50 * F.coalesce("n_data", F.lit(0)))
    top = F.max_by(F.struct("row", "score", "slots"), F.struct("score", -F.col("row")))
    return scored.groupBy(*keys).agg(top.alias("h")).select(*keys, F.col("h.row").alias("header_row"), "h.score", "h.slots")


def pivot_slots(cells: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows below the header with one column for each class, in one aggregation."""
    names = [n for n, _, _, _ in HEADERS[1:]]
    below = cells.join(headers, keys).filter(F.col("row") > F.col("header_row"))
    return below.groupBy(*keys, "row").agg(
        *(F.max(F.when(F.col("col") == F.col("slots")[n], F.col("v_str"))).alias(n) for n in names),
        F.max(F.when(F.col("col") == F.col("slots")["part_specific"], F.col("v_num"))).alias("part_num"),
    )


def index_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that number the columns: two or more small whole numbers that equal their column, follow
    each other from 0, 1 or 2, or are three or more in sequence. Numbers may be texts (``v_str``), and
    the first column may hold a label instead."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    if "v_str" in cells.columns:
        cells = cells.withColumn("v_num", F.coalesce("v_num", F.trim("v_str").try_cast("double")))
        cells = cells.filter(~((F.col("col") == 1) & F.col("v_num").isNull() & normalize_text(F.col("v_str")).isin(*INDEX_LABELS)))
    small = (F.col("v_num") == F.floor("v_num")) & F.col("v_num").between(0, 100)
    step = F.col("v_num") - F.lag("v_num").over(w)
    marked = cells.withColumn("small", F.coalesce(small, F.lit(False))).withColumn("step", step)
    g = marked.groupBy(*keys, "row").agg(
        F.bool_and("small").alias("all_small"), F.count("*").alias("n"), F.count_if(F.col("v_num") == F.col("col")).alias("own"),
        F.min("v_num").alias("least"), F.coalesce(F.bool_and(F.col("step") == 1), F.lit(False)).alias("runs"),
    )
    ok = (F.col("own") >= 2) | (F.col("runs") & F.col("least").isin(0, 1, 2)) | (F.col("runs") & (F.col("n") >= 3))
    return g.filter((F.col("n") >= 2) & F.col("all_small") & ok).select(*keys, "row")


def row_walk(rows: DataFrame, keys: list[str], order: str = "row") -> DataFrame:
    """Walk a table down to its end, by running windows instead of a loop.

    rows: is_stop, is_empty, is_idx, has_info, has_part. Kept are the items before the end: a stop
    word; an empty row after items, or the second before any; ten rows without information before
    items, or two since the last. item_seq counts them from 1.
    """
    over = lambda *p: Window.partitionBy(*keys, *p).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    k = rows.withColumn("started", F.max((c("has_part") & ~c("is_idx") & ~c("is_stop") & ~c("is_empty")).cast("int")).over(over()) == 1)
    kind = (
        F.when(c("is_stop"), "stop").when(c("is_empty"), "empty").when(c("is_idx") & ~c("started"), "idx")
        .when(~c("has_info"), "noinfo").when(c("has_part"), "item").otherwise("pass")
    )
    is_ = lambda name: (c("kind") == name).cast("int")
    k = k.withColumn("kind", kind).withColumn("cnt", F.sum(is_("item")).over(over())).withColumn("seg", F.sum(is_("idx")).over(over()))
    k = k.withColumn("emp", F.sum(is_("empty")).over(over("cnt", "seg"))).withColumn("noi", F.sum(is_("noinfo")).over(over("cnt")))
    brk = (
        (c("kind") == "stop") | ((c("kind") == "empty") & ((c("cnt") > 0) | (c("emp") >= 2)))
        | ((c("cnt") == 0) & (c("noi") >= 10)) | ((c("cnt") > 0) & (c("noi") >= 2))
    )
    k = k.withColumn("ended", F.max(brk.cast("int")).over(over())).filter("ended = 0 and kind = 'item'")
    w = Window.partitionBy(*keys).orderBy(order)
    return k.withColumn("item_seq", F.row_number().over(w)).drop("started", "kind", "cnt", "seg", "emp", "noi", "ended")


def part_lookups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a quote-information table knows, one row for each workbook: n_rows, and maps between item
    number, part number and place. rows: keys, idx (from 1), pn, number (null without such columns).

    A key that stands twice takes its last row.
    """
    last = lambda k, v: (
        rows.filter(f"{k} is not null and {v} is not null").groupBy(*keys, F.col(k).alias("k")).agg(F.max_by(v, "idx").alias("v"))
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(f"{v}_by_{k}"))
    )
    out = rows.groupBy(*keys).agg(F.max("idx").alias("n_rows"))
    for k, v in (("number", "pn"), ("idx", "pn"), ("pn", "number")):
        out = out.join(last(k, v), keys, "left")
    return out


def repaired(pn: Column, number: Column, seq: Column, quote: Column, item: Column) -> tuple[Column, Column]:
    """(part, number): a missing part by item number, else by place; a missing item number by part.

    The columns of ``part_lookups`` are null where there is no such table: nothing changes.
    """
    part = F.coalesce(pn, F.col("pn_by_number")[number], F.col("pn_by_idx")[seq])
    bare = F.trim(F.coalesce(item, F.lit("")))
    unnamed = bare.isin("", "-", "None", "0", "0.0") | (bare == F.trim(F.coalesce(quote, F.lit("None"))))
    return part, F.when(pn.isNotNull() & unnamed, F.coalesce(F.col("number_by_pn")[pn], number)).otherwise(number)
