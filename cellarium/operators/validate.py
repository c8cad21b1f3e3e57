"""Business rules, confidence and cell sanity as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DESCRIPTION_WORDS, RESIN_WORDS
from ..functions.text import any_of, round2

CANONICAL = r"^Q[0-9]{4,5}(-[A-Za-z0-9]+)+$"


def _n(c: Column) -> Column:
    return c.cast("string")


def item_warnings(item: str = "quote_item_number", known: Column | None = None, least: float = 5.0, most: float = 300.0) -> Column:
    """Warnings of an item in their order, behind those it has already."""
    c = F.col
    known = F.coalesce(known if known is not None else F.array(), F.array()).cast("array<string>")
    rules = F.array_compact(F.array(
        F.when(c("cycle_time_sec").isNull(), F.lit("Missing cycle_time_sec")).when(
            (c("cycle_time_sec") < least) | (c("cycle_time_sec") > most),
            F.concat(F.lit("Cycle time "), _n(c("cycle_time_sec")), F.lit(f"s outside expected range ({least}s–{most}s)")),
        ),
        F.when(F.coalesce(F.trim("part_number"), F.lit("")) == "", F.lit("Missing part_number")),
        F.when((c("ops_labour") < 0) | (c("ops_labour") > 1), F.concat(F.lit("#Ops / Labour "), _n(c("ops_labour")), F.lit(" outside expected range (0.0–1.0)"))),
        F.when(c("weight_g") <= 0, F.concat(F.lit("Weight "), _n(c("weight_g")), F.lit("g outside expected range (>0g)"))),
        F.when(c("annual_volume") <= 0, F.concat(F.lit("Annual volume "), _n(c("annual_volume")), F.lit(" outside expected range (>0)"))),
        F.when(
            ~c(item).rlike(CANONICAL) & ~F.exists(known, lambda w: F.lower(w).contains("inferred")),
            F.concat(F.lit("Non-standard quote item number format: "), c(item)),
        ),
    ))
    return F.array_distinct(F.concat(known, rules))


def confidence(warnings: Column) -> Column:
    """low for a missing or unlikely value, medium for any other warning, else high."""
    bad = F.exists(warnings, lambda w: w.startswith("Missing ") | w.contains(" outside expected range "))
    return F.when(bad, "low").when(F.size(warnings) > 0, "medium").otherwise("high")


def validated(items: DataFrame, least: float = 5.0, most: float = 300.0) -> DataFrame:
    known = F.col("warnings") if "warnings" in items.columns else None
    out = items.withColumn("warnings", item_warnings(known=known, least=least, most=most))
    return out.withColumn("confidence", confidence(F.col("warnings")))


def worst(c: Column) -> Column:
    """Aggregate: the worst confidence of a document's items; without items N/A."""
    return F.when(F.bool_or(c == "low"), "low").when(F.bool_or(c == "medium"), "medium").when(F.count(c) > 0, "high").otherwise("N/A")


def sanity(field: Column, value: Column) -> Column:
    """red, yellow or clean for one displayed cell (value as text)."""
    v = F.trim(value)
    low = F.lower(v)
    num = v.try_cast("double")
    blank = v.isNull() | v.isin("", "-", "--", "---", "None", "nan", "null", "N/A", "na", "#N/A", "#VALUE!", "#REF!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!")
    part_like = (v.rlike(r"^\d{5,}$") | v.rlike(r"^[A-Z0-9]{2,6}[-_][A-Z0-9]{3,}$")) & ~any_of(low.contains(w) for w in RESIN_WORDS)
    wordy = (F.size(F.split(v, r"\s+")) >= 3) | any_of(low.contains(w) for w in DESCRIPTION_WORDS) | (F.length(v) > 40)
    numeric = field.isin("ops_labour", "labour_rate", "cycle_time_sec", "weight_g", "annual_volume")
    return (
        F.when(blank | (numeric & num.isNull()), "red")
        .when((field == "material") & (F.upper(v) == "NO MAT IDENTIFIED"), "yellow")
        .when((field == "material") & part_like, "red")
        .when((field == "ops_labour") & ((num < 0) | (num > 2)), "red")
        .when((field == "ops_labour") & (num > 1), "yellow")
        .when((field == "labour_rate") & (num <= 0), "red")
        .when((field == "labour_rate") & ((num > 33) | (num < 15)), "yellow")
        .when((field == "part_number") & wordy, "red")
        .when((field == "description") & v.rlike(r"^\d{6,}$"), "red")
        .when((field == "cycle_time_sec") & (num <= 0), "red")
        .when((field == "weight_g") & ((num <= 0) | (num > 5000)), "yellow")
        .when((field == "annual_volume") & ((num <= 0) | (num > 10_000_000)), "yellow")
        .otherwise("clean")
    )


FIELDS = ("part_number", "description", "material", "cycle_time_sec", "ops_labour", "labour_rate", "weight_g", "annual_volume")


def sanity_cells(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each displayed cell: keys, field, value, severity."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in FIELDS))
    return items.select(*keys, F.inline(pairs)).withColumn("severity", sanity(F.col("field"), F.col("value")))


_ABSENT = ("", "-", "--", "n/a", "na", "none")


def contract_number(field: str, raw: Column) -> Column:
    """A text as the record takes it, rounded to two places: unlike in cells, zero and negative cycle
    times, operators and rates stay (to be warned of), and a cycle time is the whole text or null."""
    units = {"cycle_time_sec": "seconds?|secs?|s", "ops_labour": "ops|labour|labor|operators?", "labour_rate": "", "weight_g": "grams?|g"}[field]
    low = F.lower(F.trim(raw))
    bare = F.regexp_replace(low, "[$,]", "") if field == "labour_rate" else F.trim(F.regexp_replace(low, rf"\s*(?:{units})\s*$", ""))
    first = F.regexp_extract(bare, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    whole = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), bare.try_cast("double"))
    value = {"cycle_time_sec": whole, "labour_rate": first}.get(field, F.coalesce(whole, first))
    value = round2(F.when(~low.isin(*_ABSENT) & ~low.startswith("#"), value))
    return F.when(value > 0, value) if field == "weight_g" else value
