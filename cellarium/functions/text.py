"""Cleaners, keys and coordinates as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AUDIT_PHRASES, PLACEHOLDERS, STOP_WORDS, TEXT_PLACEHOLDERS, TOKEN_STOP_WORDS

NULL = None
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def col_letter(i: Column) -> Column:
    """1 to A, 27 to AA, 703 to AAA; below 1 or above 16384: null."""
    one = lambda x: F.char((F.lit(65) + x).cast("int"))
    return F.when((i < 1) | (i > 16384), NULL).otherwise(
        F.concat(
            F.when(i > 702, one(F.floor((i - 703) / 676))).otherwise(""),
            F.when(i > 26, one(F.floor((i - 27) / 26) % 26)).otherwise(""),
            one((i - 1) % 26),
        )
    )


def col_index(letters: Column) -> Column:
    """A to 1, AA to 27; anything but one to three letters: null."""
    up = F.upper(letters)
    digit = lambda k: F.when(F.length(up) >= k, (F.ascii(F.substring(F.reverse(up), k, 1)) - 64) * 26 ** (k - 1)).otherwise(0)
    return F.when(up.rlike("^[A-Z]{1,3}$"), digit(1) + digit(2) + digit(3)).cast("int")


def parse_coord(coord: Column) -> Column:
    """struct(row, col) of A1, else null."""
    ok = coord.rlike("^[A-Za-z]+[0-9]+$")
    return F.when(
        ok,
        F.struct(
            F.regexp_extract(coord, "([0-9]+)$", 1).try_cast("int").alias("row"),
            col_index(F.regexp_extract(coord, "^([A-Za-z]+)", 1)).alias("col"),
        ),
    )


def make_coord(row: Column, col: Column) -> Column:
    return F.concat(col_letter(col), row.cast("string"))


def split_coord(coord: Column) -> Column:
    """struct(sheet, cell) of Sheet!A1; without a sheet "Current Sheet"; blank: N/A twice."""
    blank = F.coalesce(F.trim(coord), F.lit("")) == ""
    at = F.instr(coord, "!")
    return F.struct(
        F.when(blank, "N/A").when(at > 0, F.substring_index(coord, "!", 1)).otherwise("Current Sheet").alias("sheet"),
        F.when(blank, "N/A").when(at > 0, coord.substr(at + 1, F.length(coord))).otherwise(coord).alias("cell"),
    )


def normalize_text(s: Column) -> Column:
    """White space as one space, without trailing " :;-.", in lower case; null: empty."""
    one = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)[\s\x{00A0}]+", " "))
    return F.lower(F.regexp_replace(one, r"[ :;\-.]+$", ""))


def _strip(s: Column, chars: str) -> Column:
    return F.regexp_replace(s, rf"^[{chars}]+|[{chars}]+$", "")


_EDGE = r" \t\r\n:;\-"
_EDGE_BRACKETS = r" \t\r\n:;\-()\[\]"


def clean_part_number(s: Column) -> Column:
    """Part number of text without drawing tags; null for blanks, placeholders, single characters,
    questions, audit phrases and sentences of four or more words."""
    one = _strip(F.regexp_replace(s, r"(?U)[\s\x{00A0}]+", " "), _EDGE)
    drawing = one.rlike(r"(?i)\b(dwg|drawing)\b")
    bracket = one.rlike(r"\s*[\(\[].*?[\)\]]\s*$")
    trimmed = _strip(F.regexp_replace(one, r"\s*[\(\[].*?[\)\]]\s*$", ""), _EDGE)
    bare = (
        F.when(drawing, _strip(F.regexp_replace(one, r"(?i)\s*[\(\[]?\s*(dwg|drawing)\b.*$", ""), _EDGE_BRACKETS))
        .when(bracket & (trimmed != ""), trimmed)
        .when(bracket, _strip(one, _EDGE_BRACKETS))
        .otherwise(one)
    )
    bad = lambda x: x.isin(*PLACEHOLDERS) | (F.length(x) <= 1) | x.contains("?")
    audit = any_of(F.lower(bare).contains(p) for p in AUDIT_PHRASES)
    return F.when(bad(one) | bad(bare) | audit | (F.size(F.split(bare, " +")) >= 4), NULL).otherwise(bare)


def clean_part_value(v_str: Column, v_num: Column) -> Column:
    """Part number of a typed cell: numbers of 0 to 9 and below are none, integral ones lose ".0"."""
    whole = v_num == F.floor(v_num)
    return F.when(
        v_num.isNotNull(),
        F.when((v_num <= 0) | (whole & (v_num <= 9)), NULL)
        .when(whole & (v_num < 1e18), v_num.cast("decimal(20,0)").cast("string"))
        .otherwise(v_str),
    ).otherwise(clean_part_number(v_str))


def bracketed_drawing(s: Column) -> Column:
    """What stands in the first brackets, without a drawing prefix; reserved words: null."""
    inner = F.trim(F.regexp_extract(s, r"(?i)[\(\[]\s*(?:dwg|drawing\s*#?\s*)?([a-zA-Z0-9\s_-]+?)\s*[\)\]]", 1))
    return F.when((inner == "") | F.lower(inner).isin("dwg", "drawing", "none", "n/a", "null"), NULL).otherwise(inner)


def clean_text(s: Column) -> Column:
    """Text without blanks and ":;-" at its ends; inner white space stays; placeholders: null."""
    bare = _strip(s, _EDGE)
    return F.when((bare == "") | bare.isin(*TEXT_PLACEHOLDERS), NULL).otherwise(bare)


def first_number(s: Column) -> Column:
    """The first unsigned number in the text."""
    return F.nullif(F.regexp_extract(s, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def round2(v: Column) -> Column:
    """Two places, rounded by the exact value of the double (7.675 stands below the tie and gives 7.67).

    Only where the nearest thousandth ends in 5 and is this very double can decimal rounding go wrong;
    there the sign of v * 1000 less that whole number decides, both halves of v taken exactly.
    """
    v = v.cast("double")
    whole = F.round(v * 1000)
    tie = (F.abs(v) < 1e12) & (whole / 1000 == v) & (F.abs(whole) % 10 == 5)
    split = v * 134217729.0
    high = split - (split - v)
    off = (high * 1000 - whole) + (v - high) * 1000
    return F.when(tie & (off < 0), (whole - 5) / 10 / 100).when(tie & (off > 0), (whole + 5) / 10 / 100).otherwise(F.bround(v, 2))


def number(s: Column) -> Column:
    """The text as a whole as a number, else null; never infinite or not a number."""
    t = F.trim(s)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def _once(v: Column, use) -> Column:
    """use(v), where v is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def _blank(t: Column, zeros: tuple[str, ...]) -> Column:
    return t.isNull() | (t == "") | t.isin("-", "--", "N/A", "NA", "None", *zeros) | t.startswith("#")


def _trim(s: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), F.lit("\u00a0"), F.lit(" ")), r"^ +| +$", "")


def _bare(t: Column, units: str) -> Column:
    """A trimmed text without its unit."""
    return _trim(F.regexp_replace(t, rf"(?i)\s*(?:{units})\s*$", ""))


def _positive(v: Column) -> Column:
    return F.when(v > 0, v)


def _round2_positive(v: Column) -> Column:
    return _once(_once(v, round2), _positive)


def _typed(v_num: Column | None, typed, text: Column) -> Column:
    """What a typed number gives, else what the text gives."""
    return text if v_num is None else F.when(v_num.isNotNull(), typed(v_num)).otherwise(text)


def clean_cycle_time(s: Column, v_num: Column | None = None) -> Column:
    """Seconds above zero, with or without a unit; else the first number in the text."""
    value = lambda t: _round2_positive(F.coalesce(_once(_bare(t, "seconds?|secs?|s|sec/shot"), number), first_number(t)))
    text = _once(_trim(s), lambda t: F.when(_blank(t, ("0", "0.0", "0.00")), NULL).otherwise(value(t)))
    return _typed(v_num, lambda v: F.when(v > 0, round2(v)), text)


def clean_ops(s: Column, v_num: Column | None = None) -> Column:
    """Operators; zero and negative numbers stay."""
    value = lambda t: _once(_once(_bare(t, "ops|labour|labor|operators?"), lambda b: F.coalesce(number(b), first_number(b))), round2)
    return _typed(v_num, round2, _once(_trim(s), lambda t: F.when(_blank(t, ()), NULL).otherwise(value(t))))


def clean_currency(s: Column, v_num: Column | None = None) -> Column:
    """A typed number; of a text the first number without $ and commas, whose sign is not part of it."""
    text = _once(_trim(F.regexp_replace(_trim(s), "[$,]", "")), lambda b: F.when(_blank(b, ()), NULL).otherwise(_once(first_number(b), round2)))
    return _typed(v_num, round2, text)


def clean_weight(s: Column, v_num: Column | None = None) -> Column:
    """Grams above zero; else the first number in the text."""
    value = lambda t: _round2_positive(F.coalesce(_once(_bare(t, "grams?|g"), number), first_number(t)))
    text = _once(_trim(s), lambda t: F.when(_blank(t, ("0", "0.0")), NULL).otherwise(value(t)))
    return _typed(v_num, lambda v: F.when(v > 0, round2(v)), text)


def clean_volume(s: Column, v_num: Column | None = None) -> Column:
    """Pieces a year above zero, rounded half to even; else the first whole number in the text."""
    first = lambda t: F.nullif(F.regexp_extract(t, "([0-9]+)", 1), F.lit("")).try_cast("long")
    whole = lambda t: F.bround(_once(_bare(t, "eau|units?|pcs?"), number), 0).cast("long")
    plain = _trim(F.replace(_trim(s), F.lit(","), F.lit("")))
    text = _once(plain, lambda t: F.when(_blank(t, ("0", "0.0")), NULL).otherwise(_once(F.coalesce(whole(t), first(t)), _positive)))
    return _typed(v_num, lambda n: F.when(n > 0, F.bround(n, 0).cast("long")), text)


def base_quote_id(s: Column, fallback: Column) -> Column:
    """Q and four or five digits; a bare number of that length; the fallback; Q0000."""
    q = F.upper(F.nullif(F.regexp_extract(s, r"(?i)\b(Q[0-9]{4,5})\b", 1), F.lit("")))
    bare = F.nullif(F.regexp_extract(s, r"\b([0-9]{4,5})\b", 1), F.lit(""))
    return F.coalesce(q, F.concat(F.lit("Q"), bare), fallback, F.lit("Q0000"))


_ITEM_ID = r"(?i)\b(Q?[0-9]{4,5}(?:[-._]r(?:ev)?[0-9]+)?[-._](?!r(?:ev)?[0-9]+\b)[A-Za-z0-9]+(?:[-._][A-Za-z0-9]+)*)\b"


def has_item_suffix(s: Column) -> Column:
    """Whether a quote number names its item: Q3428-1 does, Q3428 and Q3428-R3 do not."""
    return F.coalesce(s, F.lit("")).rlike(_ITEM_ID)


def item_suffix(s: Column) -> Column:
    """Item 1, #1 or 1 to 1; blanks and zeros: null."""
    bare = F.trim(F.regexp_replace(F.trim(s), r"\s*[\(\[].*?[\)\]]", ""))
    clean = _strip(F.regexp_replace(bare, r"(?i)^(item|line|pos)[\s#:]*", ""), r" \t\r\n:;\-#")
    return F.when((clean == "") | clean.isin("0", "0.0", "None", "null", "N/A"), NULL).otherwise(clean)


def resolve_item_number(quote: Column, item: Column, quote_id: Column, seq: Column) -> Column:
    """struct(number, inferred): the quote's own item id, else base and item, else base and sequence."""
    full = F.regexp_extract(quote, _ITEM_ID, 1)
    own = F.translate(F.upper(full), "._", "--")
    own = F.when(own.startswith("Q"), own).otherwise(F.concat(F.lit("Q"), own))
    base = base_quote_id(quote, quote_id)
    suffix = item_suffix(item)
    suffix = F.when(suffix.rlike(r"(?i)^Q?[0-9]{4,5}([-._]r(ev)?[0-9]+)?$"), NULL).otherwise(suffix)
    named = F.translate(F.upper(F.regexp_extract(suffix, r"(?i)\b(Q[0-9]{4,5}(?:[-._][A-Za-z0-9]+)+)\b", 1)), "._", "--")
    number_ = (
        F.when(has_item_suffix(quote), own)
        .when(suffix.isNotNull() & (named != ""), named)
        .when(suffix.isNotNull(), F.concat_ws("-", base, F.regexp_replace(suffix, "^-+", "")))
        .otherwise(F.concat_ws("-", base, seq.cast("string")))
    )
    inferred = ~has_item_suffix(quote) & suffix.isNull()
    return F.struct(
        number_.alias("number"),
        F.when(inferred, F.concat(F.lit("Inferred quote item number suffix '-"), seq.cast("string"), F.lit("' from base quote "), base)).alias("warning"),
    )


def normalize_part_number(s: Column) -> Column:
    """Key for matching: lower case, without a last bracket, revision and separators; null: empty."""
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    t = F.regexp_replace(t, r"\s*[\(\[][a-z0-9\s_-]+[\)\]]$", "")
    t = F.regexp_replace(t, r"[-_]rev(ision)?[-_\s]*[a-z0-9]*$", "")
    t = F.regexp_replace(t, r"[-_]r?[a-z0-9]{1,2}$", "")
    return F.regexp_replace(t, r"[\s\-_.:/]+", "")


def matching_tokens(s: Column) -> Column:
    """Distinct keys in order: the whole, bracket bodies, what is before brackets, words, what is
    behind the first space."""
    t = F.trim(F.coalesce(s, F.lit("")))
    none = F.array().cast("array<string>")
    bodies = F.regexp_extract_all(t, F.lit(r"[\(\[]\s*([a-zA-Z0-9\s_-]+)\s*[\)\]]"), F.lit(1))
    before = F.filter(F.array(F.trim(F.regexp_replace(t, r"\s*[\(\[].*?[\)\]].*$", ""))), lambda b: b != "")
    words = F.filter(F.transform(F.split(t, r"\s+"), lambda w: _strip(w, _EDGE_BRACKETS)), lambda w: w != "")
    several = _once(words, lambda w: F.when(F.size(w) >= 2, F.concat(w, F.array(F.regexp_replace(t, r"^\S+\s+", "")))).otherwise(none))
    keys = F.transform(F.array_distinct(F.concat(F.array(t), bodies, before, several)), normalize_part_number)
    return F.array_distinct(F.filter(keys, lambda k: (F.length(k) >= 2) & ~k.isin(*TOKEN_STOP_WORDS)))


def kw_match(norm: Column, *kws: str) -> Column:
    """Whether the text is one of the keywords, begins with one and a space, or ends with a space and one."""
    every = "|".join(re.escape(k) for k in kws)
    return norm.rlike(f"^(?:{every})(?: |$)| (?:{every})$")


def is_drawing_value(s: Column) -> Column:
    u = F.upper(F.trim(s))
    return u.startswith("DWG-") | u.startswith("DWG #") | u.startswith("DRAWING-")


def is_stop(s: Column) -> Column:
    """Whether a cell ends a table: a stop word alone, before a space, colon or dash, or at the end."""
    n = _strip(normalize_text(s), r"*_# :;\-")
    every = "|".join(STOP_WORDS)
    return n.rlike(f"^(?:{every})(?:[ :-]|$)| (?:{every})$") | F.replace(n, F.lit("-"), F.lit("")).isin(*STOP_WORDS)
