"""Documents and their items: flat rows, totals, run metrics, display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import EXPORT_COLUMNS
from .validate import worst

_NUMBERS = ("cycle_time_sec", "ops_labour", "labour_rate", "weight_g", "annual_volume")


def flat_rows(items: DataFrame) -> DataFrame:
    """The 22 export columns: null texts are empty, numbers stay null, warnings are joined by "; "."""
    out = []
    for name in EXPORT_COLUMNS:
        if name == "warnings":
            c = F.concat_ws("; ", "warnings")
        elif name not in items.columns:
            c = F.lit(None).cast("double") if name in _NUMBERS else F.lit("")
        else:
            c = F.col(name) if name in _NUMBERS else F.coalesce(F.col(name).cast("string"), F.lit(""))
        out.append(c.alias(name))
    return items.select(*out)


def frame(items: DataFrame) -> DataFrame:
    """The export columns in the order of frames: the item, its confidence and warnings, its document, its places."""
    places = [c for c in EXPORT_COLUMNS if c.endswith("_coord")]
    item = [c for c in EXPORT_COLUMNS if c not in ("source_file", "quote_id", "warnings", *places)]
    return flat_rows(items).select(*item, "warnings", "source_file", "quote_id", *places)


def key_figures(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What a workspace shows above its table, for each document: quote_id ("N/A" where none), total_items, confidence."""
    first = F.regexp_extract(F.min_by("quote_item_number", order), r"^(Q[0-9]{4,5})", 1)
    return items.groupBy(*keys).agg(
        F.when(first != "", first).otherwise("N/A").alias("quote_id"), F.count("*").alias("total_items"), F.upper(worst(F.col("confidence"))).alias("confidence"),
    )


def totals(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Number of items and the base id of the first, for each document."""
    first = F.min_by("quote_item_number", order)
    return items.groupBy(*keys).agg(F.count("*").alias("total_items"), F.regexp_extract(first, r"^(Q[0-9]{4,5})", 1).alias("quote_id"))


def run_metrics(documents: DataFrame) -> DataFrame:
    """documents(total_items, n_warnings, failed) to one row."""
    return documents.agg(
        F.count("*").alias("files"), F.count_if(F.col("total_items") > 0).alias("quotes"),
        F.coalesce(F.sum("total_items"), F.lit(0)).cast("long").alias("items"),
        F.coalesce(F.sum("n_warnings"), F.lit(0)).cast("long").alias("warnings"),
        F.count_if(F.col("failed")).alias("failed_files"),
    )
