"""Operators over the cell relation (sheet keys, ord, row, col, v_str): lookups are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import DRAWING_ANCHORS, HEADERS, ITEM_LABELS, OFFSETS, RATE_BELOW, RATE_PARTS
from ..functions.text import any_of, clean_currency, kw_match, normalize_text

_OUT = {name: out for name, _, out, _ in HEADERS}


def extent(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest row and column with a value, for each sheet."""
    return cells.filter("trim(v_str) <> ''").groupBy(*keys).agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def _not_for(field: str, norm: Column) -> Column:
    """Whether a label that names ``field`` stands for something else."""
    if field == "part_number":
        return is_other_label(norm)
    words = {"description": _OUT["description"], "material": _OUT["material_generic"], "material_grade": _OUT["material_generic"]}.get(field)
    return any_of(norm.contains(w) for w in words) if words else F.lit(False)


def is_other_label(norm: Column) -> Column:
    """Whether a text is a label of drawings or items."""
    return kw_match(norm, *DRAWING_ANCHORS, *ITEM_LABELS)


def anchors(cells: DataFrame, words: dict[str, tuple[str, ...]], rows: int = 149, cols: int = 19) -> DataFrame:
    """Cells that are labels, once for each field they name; those that stand for something else are none."""
    norm = normalize_text(F.col("v_str"))
    fields = F.array_compact(F.array(*(F.when(kw_match(norm, *kws) & ~_not_for(f, norm), F.struct(F.lit(f).alias("field"))) for f, kws in words.items())))
    near = cells.filter((F.col("row") <= rows) & (F.col("col") <= cols))
    return near.select(*cells.columns, F.inline(fields))


def targets(labels: DataFrame, cells: DataFrame, keys: list[str], offsets=OFFSETS, merges: DataFrame | None = None, spacers: int = 2, inline: bool = False) -> DataFrame:
    """The value at each offset from each label, behind the label's merged range; try_no is 1 for the first offset.

    To the right up to ``spacers`` empty columns are passed over. Where the cell that is found (the first
    one if all are empty) stands in a merged range, the value is that of the range's first cell. With
    ``inline`` what stands behind a colon in the label itself is try 0. Every try is a row of one equi-join.
    """
    own = labels.columns
    if merges is not None:
        m = merges.select(*keys, "min_row", "min_col", "max_row", "max_col")
        inside = labels.join(m, keys).filter("row between min_row and max_row and col between min_col and max_col")
        ends = inside.groupBy(*keys, "row", "col").agg(F.max("max_row").alias("end_row"), F.max("max_col").alias("end_col"))
        placed = labels.join(ends, [*keys, "row", "col"], "left")
    else:
        placed = labels.withColumns({"end_row": F.lit(None).cast("int"), "end_col": F.lit(None).cast("int")})
    tries = [(n, s, dr, dc) for n, (dr, dc) in enumerate(offsets, 1) for s in range(1 + spacers if dc > 0 else 1)]
    steps = F.array(*(
        F.struct(
            F.lit(n).alias("try_no"), F.lit(s).alias("skip"),
            (F.when(F.lit(dr) > 0, F.coalesce("end_row", "row")).otherwise(F.col("row")) + dr).alias("t_row"),
            (F.when(F.lit(dc) > 0, F.coalesce("end_col", "col")).otherwise(F.col("col")) + dc + s).alias("t_col"),
        )
        for n, s, dr, dc in tries
    ))
    tried = placed.select(*own, F.inline(steps))
    num = F.col("v_num") if "v_num" in cells.columns else F.lit(None).cast("double")
    there = cells.filter("trim(v_str) <> ''").select(*keys, F.col("row").alias("t_row"), F.col("col").alias("t_col"), F.col("v_str").alias("value"), num.alias("value_num"))
    at = [*keys, "t_row", "t_col"]
    if spacers or merges is not None:
        place = F.struct(F.col("value").isNull(), "skip", "t_row", "t_col", "value", "value_num")
        hits = tried.join(there, at, "left" if merges is not None else "inner")
        tried = hits.groupBy(*own, "try_no").agg(F.min(place).alias("p")).select(*own, "try_no", "p.t_row", "p.t_col", "p.value", "p.value_num")
    else:
        tried = tried.join(there, at).select(*own, "try_no", "t_row", "t_col", "value", "value_num")
    if merges is not None:
        m = merges.select(*(F.col(k).alias(f"m_{k}") for k in keys), "min_row", "min_col", "max_row", "max_col")
        held = [F.col(k) == F.col(f"m_{k}") for k in keys] + [F.expr("t_row between min_row and max_row and t_col between min_col and max_col")]
        tried = tried.drop("value", "value_num").join(m, held, "left").withColumns({"t_row": F.coalesce("min_row", "t_row"), "t_col": F.coalesce("min_col", "t_col")})
        tried = tried.select(*own, "try_no", "t_row", "t_col").join(there, at).select(*own, "try_no", "t_row", "t_col", "value", "value_num")
    if inline:
        behind = F.trim(F.regexp_extract("v_str", r"(?s)^[^:]*:(.*)$", 1))
        said = labels.select(*own, F.lit(0).alias("try_no"), F.col("row").alias("t_row"), F.col("col").alias("t_col"), behind.alias("value"), F.lit(None).cast("double").alias("value_num"))
        tried = tried.unionByName(said.filter("value <> ''"))
    return tried


def best_targets(found: DataFrame, keys: list[str], clean: Column, order=("try_no", "ord"), blank: Column | None = None) -> DataFrame:
    """For each sheet and field the cleaned value of the least ``order`` among each label's first try that gives one.

    A try where ``blank`` holds ends its label's search too: without value, and behind all that have one.
    """
    rows = found.withColumn("clean", clean)
    rows = rows.filter(F.col("clean").isNotNull() | blank if blank is not None else F.col("clean").isNotNull())
    first = rows.groupBy(*keys, "field", "ord").agg(F.min(F.struct("try_no", "clean", "t_row", "t_col")).alias("f")).select(*keys, "field", "ord", "f.*")
    best = F.min(F.struct(F.col("clean").isNull(), *order, "clean", "t_row", "t_col"))
    return first.groupBy(*keys, "field").agg(best.alias("b")).select(*keys, "field", "b.clean", "b.t_row", "b.t_col")


def rates(cells: DataFrame, words: tuple[str, ...], keys: list[str]) -> DataFrame:
    """(keys, rate, t_row, t_col): what stands up to three rows below, then two columns right of, the first label of a rate that has one."""
    norm = normalize_text(F.col("v_str"))
    near = cells.filter("row < 150 and col < 30").withColumn("norm", norm)
    named = kw_match(F.col("norm"), *words) | any_of(F.col("norm").contains(w) for w in RATE_PARTS)
    below = cells.filter(any_of(norm.contains(w) for w in RATE_BELOW)).select(*keys, (F.col("row") - 1).alias("row"), "col")
    bare = near.filter(F.col("norm").isin("labour", "labor")).join(below, [*keys, "row", "col"], "left_semi")
    labels = near.filter(named).unionByName(bare.filter(~named).select(*near.columns)).withColumn("field", F.lit("labour_rate"))
    found = targets(labels, cells, keys, ((1, 0), (2, 0), (3, 0), (0, 1), (0, 2)), spacers=0)
    best = best_targets(found, keys, clean_currency(F.col("value"), F.col("value_num")), ("ord", "try_no"))
    return best.select(*keys, F.col("clean").alias("rate"), "t_row", "t_col")


def in_merged(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the least-ord merged range that holds them; an equi-join on sheet and row."""
    rows = merges.filter("min_row <= max_row").withColumn("row", F.explode(F.sequence("min_row", "max_row")))
    hit = cells.join(rows, [*keys, "row"]).filter(F.col("col").between(F.col("min_col"), F.col("max_col")))
    return hit.groupBy(*keys, "row", "col").agg(F.min(F.struct("merge_ord", "min_row", "min_col")).alias("m")).select(
        *keys, "row", "col", "m.merge_ord", F.col("m.min_row").alias("top_row"), F.col("m.min_col").alias("top_col")
    )


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; the order names all that tells rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
