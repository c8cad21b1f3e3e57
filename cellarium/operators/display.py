"""Frames for people: display columns, coordinate texts, number formats, edited rows, linked jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the contract, in natural order.
DISPLAY = {
    "quote_item_number": "Quote Item", "part_number": "Part Number", "description": "Description", "material": "Material",
    "cycle_time_sec": "Cycle Sec", "ops_labour": "#Ops", "labour_rate": "Labour Rate ($CAD/Hr)", "weight_g": "Weight (g)",
    "annual_volume": "Ann. Volume (EAU)", "confidence": "Confidence",
}
COORD_TAGS = {
    "quote_num": "Q", "part_num": "PN", "description": "Desc", "material": "Mat", "cycle_time": "CT", "ops_labour": "Ops",
    "labour_rate": "LR", "weight_g": "Wt", "annual_volume": "Vol",
}
MATCHED, NO_QUOTE, NO_JOB = "🟢 Matched", "🔴 Job without Quote", "🟡 Quote without Job"

_TEXTS = ("quote_item_number", "part_number", "description", "material")
_DECIMALS = ("cycle_time_sec", "ops_labour", "labour_rate", "weight_g")


def _shown(name: str) -> Column:
    return F.coalesce(name, F.lit("")) if name in _TEXTS else F.col(name)


def coords_text(suffix: str = "_coord") -> Column:
    """"Q: A1, PN: B1" of the coordinate columns that have one, else "-"."""
    parts = F.array_compact(F.array(*(
        F.when(F.col(n + suffix) != "", F.concat(F.lit(f"{tag}: "), F.col(n + suffix))) for n, tag in COORD_TAGS.items()
    )))
    return F.when(F.size(parts) > 0, F.concat_ws(", ", parts)).otherwise("-")


def parse_coords(s: Column) -> Column:
    """The struct that ``coords_text`` wrote; a coordinate ends at white space, comma or semicolon."""
    one = lambda tag: F.nullif(F.regexp_extract(s, rf"(?i)\b{tag}:\s*([^\s,;]+)", 1), F.lit(""))
    return F.struct(*(one(tag).alias(n) for n, tag in COORD_TAGS.items()))


def display_rows(items: DataFrame, coords: bool = False) -> DataFrame:
    """The display columns: null texts are empty, numbers stay null, warnings joined by "; "."""
    more = [coords_text().alias("Cell Coordinates")] if coords else []
    return items.select(*(_shown(n).alias(title) for n, title in DISPLAY.items()), *more, F.concat_ws("; ", "warnings").alias("Warnings"))


def formatted(field: str, value: Column) -> Column:
    """A number as shown: two decimals, rates with $, volumes with commas; null: "-"."""
    if field == "annual_volume":
        out = F.format_number(value.cast("long"), 0)
    else:
        out = F.format_string(("$" if field == "labour_rate" else "") + "%.2f", value.cast("double"))
    return F.when(value.isNotNull(), out).otherwise("-")


def matching(rows: DataFrame, query: str, severity: str | None = None) -> DataFrame:
    """Display rows that hold ``query`` in any column; with ``severity`` (a column) only rows it does not call clean."""
    hit = F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in rows.columns))).contains(query.strip().lower())
    return rows.filter(hit & (F.col(severity) != "clean") if severity else hit)


def canonical(edited: DataFrame, keys: list[str], order: str, quote_id: Column) -> DataFrame:
    """Edited display rows to items: blank numbers are named by place, decimals rounded to two places,
    volumes to whole ones, unknown confidences are medium, warnings are split again.

    Decimals round half to even at the second place of the number as written.
    """
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    number = lambda c: text(c).try_cast("double")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("string")
    title = lambda n: DISPLAY[n]
    conf = F.lower(text("Confidence"))
    warnings = F.filter(F.transform(F.split(F.coalesce(text("Warnings"), F.lit("")), ";"), lambda w: F.trim(w)), lambda w: w != "")
    coords = parse_coords(F.col("`Cell Coordinates`")) if "Cell Coordinates" in edited.columns else parse_coords(F.lit(""))
    return edited.select(
        *keys, F.coalesce(text("Quote Item"), F.concat_ws("-", F.coalesce(quote_id, F.lit("Q1001")), place)).alias("quote_item_number"),
        *(text(title(n)).alias(n) for n in _TEXTS[1:]),
        *(F.bround(number(title(n)), 2).alias(n) for n in _DECIMALS), F.bround(number(title("annual_volume"))).cast("long").alias("annual_volume"),
        F.when(conf.isin("high", "medium", "low"), conf).otherwise("medium").alias("confidence"), warnings.alias("warnings"), coords.alias("source_cell_coords"),
    )


_NUMBERS = ("cycle_time_sec", "ops_labour", "labour_rate", "weight_g", "annual_volume")


def linked_rows(linked: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every job beside its quote, in display columns (job_ord first): the job's part, else the quote's."""
    q = quotes.withColumnRenamed("part_number", "quote_part")
    both = linked.join(q, "quote_ord", "left")
    part = F.coalesce(F.nullif(F.col("part_number"), F.lit("")), F.col("quote_part"), F.lit(""))
    return both.select(
        "job_ord", F.col("job_number").alias("Job Number"), part.alias("Part Number"), _shown("quote_item_number").alias(DISPLAY["quote_item_number"]),
        *(_shown(n).alias(DISPLAY[n]) for n in ("description", "material", *_NUMBERS)),
        F.when(F.col("status") == "matched", MATCHED).otherwise(NO_QUOTE).alias("Link Status"), F.upper("confidence").alias("Match Confidence"),
    )


def unlinked_rows(quotes: DataFrame) -> DataFrame:
    """Quotes that no job took, in display columns (quote_ord first)."""
    return quotes.select("quote_ord", *(_shown(n).alias(title) for n, title in DISPLAY.items()), F.lit(NO_JOB).alias("Link Status"))
