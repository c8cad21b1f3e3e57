"""Which sheets count: visibility, ignored titles, scores and ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import (
    IGNORED_SHEETS, MPC_NAMES, MPC_NUMBERED, MPC_TIERS, QINFO_NAMES, QINFO_NUMBERED, QINFO_TIERS, TAB_NUMBER, TARGET_SHEETS,
)
from ..functions.text import any_of


def is_visible(state: Column) -> Column:
    return ~F.lower(F.coalesce(state, F.lit("visible"))).isin("hidden", "veryhidden")


def is_ignored(norm: Column, words: tuple[str, ...] = IGNORED_SHEETS) -> Column:
    """Whether a title (trimmed, lower case) is an ignored word in singular or plural, or holds it as a word."""
    def one(k: str) -> Column:
        stem = k.rstrip("s")
        same = norm.isin(k, k + "s", k + "es") | (F.regexp_replace(norm, "s+$", "") == stem)
        return same | F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {k} ") | norm.rlike(rf"\b{re.escape(stem)}s?\b")

    return any_of(one(k) for k in words if k)


def is_target(title: Column, words: tuple[str, ...] = TARGET_SHEETS) -> Column:
    """Whether a title names a quote sheet: mpc as a word or at its start, or quote information."""
    norm = F.lower(F.trim(title))
    named = any_of(norm.rlike(rf"(^|[ _\-]){re.escape(k)}($|[ _\-])|\b{re.escape(k)}\b") for k in words)
    return named | norm.rlike(r"^mpc") | norm.rlike(r"\bq[-_ ]?info\b|\bquote[-_ ]?info\b")


def _tiers(norm: Column, tiers: tuple[tuple[str, int], ...]) -> Column:
    """The score of the first pattern that a title has: 1000 flat, any other less the title's length."""
    out = F.lit(0)
    for pattern, points in reversed(tiers):
        out = F.when(norm.rlike(pattern), points if points == 1000 else points - F.length(norm)).otherwise(out)
    return out


def mpc_score(norm: Column) -> Column:
    """How closely a title (trimmed, lower case) names an MPC sheet; zero or less: not at all."""
    return _tiers(norm, MPC_TIERS)


def qinfo_score(norm: Column) -> Column:
    """How closely a title (trimmed, lower case) names a quote-information sheet."""
    return _tiers(norm, QINFO_TIERS)


def ranked(sheets: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Sheets with a score above zero, the best of each workbook first; ties: workbook order."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "sheet_idx")
    return sheets.withColumn("score", score).filter("score > 0").withColumn("rank", F.row_number().over(w))


def candidates(sheets: DataFrame, keys: list[str], ignored: tuple[str, ...] = IGNORED_SHEETS) -> DataFrame:
    """The sheets to read of each workbook, of those that are visible, not ignored and not empty.

    Quote information before MPC, unless its best sheet lacks cycle times that the best MPC sheet has.
    Of the kind chosen: the first sheet that bears the name itself; else all of them if there are
    several and each is numbered; else the one that names it best. Neither kind: all sheets.

    sheets: keys, sheet_idx, title, norm (title trimmed, in lower case), state, n_cells, has_cycle.
    """
    norm = F.col("norm")
    seen = sheets.filter(is_visible(F.col("state")) & (F.col("n_cells") > 0) & ~is_ignored(norm, ignored))
    seen = seen.withColumns({"q": qinfo_score(norm), "m": mpc_score(norm)})
    w = Window.partitionBy(*keys)
    marks = {}
    for k, names, numbered in (("q", QINFO_NAMES, QINFO_NUMBERED), ("m", MPC_NAMES, MPC_NUMBERED)):
        own = F.col(k) > 0
        marks |= {
            f"{k}_best": F.max(F.when(own, F.struct(k, (-F.col("sheet_idx")).alias("at"), "has_cycle"))).over(w),
            f"{k}_named": F.min(F.when(own & norm.isin(*names), F.col("sheet_idx"))).over(w),
            f"{k}_all": (F.count_if(own).over(w) > 1) & F.coalesce(F.bool_and(F.when(own, norm.rlike(numbered))).over(w), F.lit(False)),
        }
    r = seen.withColumns(marks)
    idx = F.col("sheet_idx")

    def chosen(k: str, several: Column) -> Column:
        named, best = F.col(f"{k}_named"), -F.col(f"{k}_best.at")
        return F.when(named.isNotNull(), idx == named).when(several, F.col(k) > 0).otherwise(idx == best)

    lacks = F.col("q_best").isNotNull() & F.col("m_best").isNotNull() & ~F.col("q_best.has_cycle") & F.col("m_best.has_cycle")
    pick = (
        F.when(lacks, chosen("m", F.lit(False))).when(F.col("q_best").isNotNull(), chosen("q", F.col("q_all")))
        .when(F.col("m_best").isNotNull(), chosen("m", F.col("m_all"))).otherwise(True)
    )
    return r.filter(pick).select(*sheets.columns)


def tab_number(title: Column, found: Column, base: Column, place: Column) -> Column:
    """The quote item number of a sheet that is one item: the one found on it, the one in its title, the
    quote with the number in its title, the quote with the sheet's place among such sheets.

    found: the quote number of the sheet; base: that of the workbook; without both Q0000.
    """
    canonical = r"\b(Q[0-9]{4,5}(?:-[A-Za-z0-9]+)+)\b"
    quote = F.coalesce(base, F.when(found.startswith("Q"), found), F.lit("Q0000"))
    numbered = F.nullif(F.regexp_extract(title, TAB_NUMBER, 1), F.lit(""))
    return F.coalesce(
        F.upper(F.nullif(F.regexp_extract(found, canonical, 1), F.lit(""))), F.upper(F.nullif(F.regexp_extract(title, canonical, 1), F.lit(""))),
        F.when(numbered.isNotNull(), F.concat(quote, F.lit("-"), numbered)),
        F.concat(quote, F.lit("-"), place.cast("string")),
    )
