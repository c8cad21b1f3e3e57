"""DuckDB statements with the results of the registered queries."""

from __future__ import annotations

from ..functions.constants import ANCHORS, AUDIT_PHRASES, DESCRIPTION_WORDS, DRAWING_ANCHORS, EXPORT_COLUMNS, HEADERS, IGNORED_SHEETS, ITEM_LABELS, PLACEHOLDERS, RATE_ANCHORS, RATE_BELOW, RATE_PARTS, RESIN_WORDS, STOP_WORDS, TOKEN_STOP_WORDS
from . import queries as q


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _norm(x: str) -> str:
    return rf"lower(regexp_replace(trim(regexp_replace(coalesce({x}, ''), '[\s\x{{00A0}}]+', ' ', 'g')), '[ :;\-.]+$', ''))"


def _strip(x: str, chars: str) -> str:
    return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"


def _kw(n: str, k: str) -> str:
    return f"({n} = '{k}' OR starts_with({n}, '{k} ') OR ends_with({n}, ' {k}'))"


EDGE, EDGE_B = r" \t\r\n:;\-", r" \t\r\n:;\-()\[\]"


def _np(x: str) -> str:
    s = f"lower(trim(coalesce({x}, '')))"
    for p, g in ((r"\s*[\(\[][a-z0-9\s_-]+[\)\]]$", ""), (r"[-_]rev(ision)?[-_\s]*[a-z0-9]*$", ""), (r"[-_]r?[a-z0-9]{1,2}$", ""), (r"[\s\-_.:/]+", ", 'g'")):
        s = f"regexp_replace({s}, '{p}', ''{g})"
    return s


def _all_tokens(x: str) -> str:
    """The keys of a text in their order, with repeats and those that do not count."""
    s = f"trim(coalesce({x}, ''))"
    words = f"list_filter(list_transform(string_split_regex({s}, '\\s+'), lambda w: {_strip('w', EDGE_B)}), lambda w: w <> '')"
    before = f"trim(regexp_replace({s}, '\\s*[\\(\\[].*?[\\)\\]].*$', ''))"
    every = (
        f"list_concat(list_concat(list_concat([{s}], regexp_extract_all({s}, '[\\(\\[]\\s*([a-zA-Z0-9\\s_-]+)\\s*[\\)\\]]', 1)), [{before}]), "
        f"CASE WHEN len({words}) >= 2 THEN list_concat({words}, [regexp_replace({s}, '^\\S+\\s+', '')]) ELSE [] END)"
    )
    return f"list_transform({every}, lambda k: {_np('k')})"


def _tokens(x: str) -> str:
    """The distinct tokens as a list, in no order."""
    return f"list_distinct(list_filter({_all_tokens(x)}, lambda k: length(k) >= 2 AND k NOT IN {_in(TOKEN_STOP_WORDS)}))"


def _clean_part() -> str:
    one = _strip(r"regexp_replace(raw, '[\s\x{00A0}]+', ' ', 'g')", EDGE)
    drawing = _strip(r"regexp_replace(one, '(?i)\s*[\(\[]?\s*(dwg|drawing)\b.*$', '')", EDGE_B)
    trimmed = _strip(r"regexp_replace(one, '\s*[\(\[].*?[\)\]]\s*$', '')", EDGE)
    bad = lambda c: f"({c} IN {_in(PLACEHOLDERS)} OR length({c}) <= 1 OR contains({c}, '?'))"
    audit = " OR ".join(f"contains(lower(bare), '{p}')" for p in AUDIT_PHRASES)
    inner = r"trim(regexp_extract(raw, '(?i)[\(\[]\s*(?:dwg|drawing\s*#?\s*)?([a-zA-Z0-9\s_-]+?)\s*[\)\]]', 1))"
    return rf"""WITH a AS (SELECT p_partkey, {q.PART_TEXT} AS raw FROM part), b AS (SELECT *, {one} AS one FROM a),
 c AS (SELECT *, CASE WHEN regexp_matches(one, '(?i)\b(dwg|drawing)\b') THEN {drawing}
  WHEN regexp_matches(one, '\s*[\(\[].*?[\)\]]\s*$') AND {trimmed} <> '' THEN {trimmed}
  WHEN regexp_matches(one, '\s*[\(\[].*?[\)\]]\s*$') THEN {_strip('one', EDGE_B)} ELSE one END AS bare, {inner} AS inner_ FROM b)
 SELECT p_partkey, CASE WHEN {bad('one')} OR {bad('bare')} OR {audit} OR len(string_split_regex(bare, ' +')) >= 4 THEN NULL ELSE bare END AS part_number,
 CASE WHEN inner_ = '' OR lower(inner_) IN ('dwg', 'drawing', 'none', 'n/a', 'null') THEN NULL ELSE inner_ END AS drawing_number FROM c"""


def _r2(x: str) -> str:
    """Two places by the exact value."""
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


def _measure(units: str, of: str = "t") -> tuple[str, str]:
    """The text without its unit, and the number that it is as a whole."""
    bare = rf"trim(regexp_replace({of}, '(?i)\s*({units})\s*$', ''))"
    return bare, rf"CASE WHEN regexp_matches({bare}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({bare} AS DOUBLE) END"


def _clean_numbers() -> str:
    hole = lambda x, *zeros: f"({x} = '' OR {x} IN {_in(('-', '--', 'N/A', 'NA', 'None', *zeros))} OR starts_with({x}, '#'))"
    first = lambda x: f"TRY_CAST(nullif(regexp_extract({x}, '([0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE)"
    pos = lambda x, *zeros, of="t": f"CASE WHEN {hole(of, *zeros)} OR {x} <= 0 THEN NULL ELSE {x} END"
    money = "regexp_replace(t, '[$,]', '', 'g')"
    cycle = _r2(f"coalesce({_measure('seconds?|secs?|s|sec/shot')[1]}, {first('t')})")
    bare, whole = _measure("ops|labour|labor|operators?")
    ops = _r2(f"coalesce({whole}, {first(bare)})")
    weight = _r2(f"coalesce({_measure('grams?|g')[1]}, {first('t')})")
    vol = f"coalesce(CAST(round_even({_measure('eau|units?|pcs?', 'p')[1]}, 0) AS BIGINT), TRY_CAST(nullif(regexp_extract(p, '([0-9]+)', 1), '') AS BIGINT))"
    return f"""WITH a AS (SELECT raw, trim(raw) AS t, replace(trim(raw), ',', '') AS p FROM (SELECT {q.CELL_TEXT} AS raw FROM lineitem)),
 b AS (SELECT raw, {pos(cycle, '0', '0.0', '0.00')} AS cycle_time, CASE WHEN {hole('t')} THEN NULL ELSE {ops} END AS ops,
 CASE WHEN {hole(money)} THEN NULL ELSE {_r2(first(money))} END AS currency, {pos(weight, '0', '0.0')} AS weight, {pos(vol, '0', '0.0', of='p')} AS volume FROM a)
 SELECT *, count(*) AS n FROM b GROUP BY ALL"""


def _resolve() -> str:
    # The suffix rule needs a look-ahead; said without one: an id whose last parts are not a revision alone.
    tail = r"(?i)\bQ?[0-9]{4,5}(?:[-._]r(?:ev)?[0-9]+)?[-._][A-Za-z0-9]+(?:[-._][A-Za-z0-9]+)*\b"
    rev = r"(?i)^Q?[0-9]{4,5}(?:[-._]r(?:ev)?[0-9]+)$"
    suffix = _strip(r"regexp_replace(trim(regexp_replace(trim(i), '\s*[\(\[].*?[\)\]]', '', 'g')), '(?i)^(item|line|pos)[\s#:]*', '')", r" \t\r\n:;\-#")
    return rf"""WITH a AS (SELECT o_orderkey, {q.QUOTE_TEXT} AS q, {q.ITEM_TEXT} AS i, CAST(o_orderkey % 3 + 1 AS INT) AS seq FROM orders),
 b AS (SELECT *, regexp_extract(q, '{tail}') AS full_, {suffix} AS sfx0,
  coalesce(upper(nullif(regexp_extract(q, '(?i)\b(Q[0-9]{{4,5}})\b', 1), '')), 'Q' || nullif(regexp_extract(q, '\b([0-9]{{4,5}})\b', 1), ''), 'Q9999') AS base FROM a),
 c AS (SELECT *, full_ <> '' AND NOT regexp_matches(full_, '{rev}') AS has, CASE WHEN sfx0 IN ('', '0', '0.0', 'None', 'null', 'N/A') THEN NULL ELSE sfx0 END AS sfx FROM b)
 SELECT o_orderkey, CASE WHEN has AND starts_with(upper(full_), 'Q') THEN translate(upper(full_), '._', '--') WHEN has THEN 'Q' || translate(upper(full_), '._', '--')
  WHEN sfx IS NOT NULL THEN base || '-' || regexp_replace(sfx, '^-+', '') ELSE base || '-' || CAST(seq AS STRING) END AS quote_item_number,
 CASE WHEN NOT has AND sfx IS NULL THEN 'Inferred quote item number suffix ''-' || CAST(seq AS STRING) || ''' from base quote ' || base END AS warning FROM c"""


def _stop() -> str:
    raw = "concat(CASE p_partkey % 7 WHEN 0 THEN 'TOTAL' WHEN 1 THEN '* Notes:' WHEN 2 THEN 'Sub-Total' WHEN 3 THEN 'Grand Total' WHEN 4 THEN 'Revision-B' WHEN 5 THEN 'Totally' ELSE p_name END, CASE WHEN p_size % 2 = 0 THEN ' : ' ELSE '' END)"
    tests = " OR ".join(f"n = '{k}' OR replace(n, '-', '') = '{k}' OR starts_with(n, '{k} ') OR starts_with(n, '{k}:') OR starts_with(n, '{k}-') OR ends_with(n, ' {k}')" for k in STOP_WORDS)
    stripped = _strip(_norm("raw"), r"*_# :;\-")
    return f"WITH a AS (SELECT p_partkey, {stripped} AS n FROM (SELECT p_partkey, {raw} AS raw FROM part)) SELECT p_partkey, ({tests}) AS stops FROM a"


ITEM_ROWS = f"items AS (SELECT {q.ITEMS} FROM lineitem)"
#: Every rule as a number, in place of its message: for counts of warnings.
RULES = """flags AS (SELECT *, CAST(cycle_time_sec IS NULL AS INT) AS w1, CAST(coalesce(cycle_time_sec < 5 OR cycle_time_sec > 300, false) AS INT) AS w2,
 CAST(coalesce(trim(part_number), '') = '' AS INT) AS w3, CAST(coalesce(ops_labour < 0 OR ops_labour > 1, false) AS INT) AS w4, CAST(coalesce(weight_g <= 0, false) AS INT) AS w5,
 CAST(coalesce(annual_volume <= 0, false) AS INT) AS w6, CAST(NOT regexp_matches(quote_item_number, '^Q[0-9]{4,5}(-[A-Za-z0-9]+)+$') AS INT) AS w7 FROM items),
 rated AS (SELECT *, w1 + w2 + w3 + w4 + w5 + w6 + w7 AS n_warnings, CASE WHEN w1 + w2 + w3 + w4 + w5 + w6 > 0 THEN 'low' WHEN w7 > 0 THEN 'medium' ELSE 'high' END AS confidence FROM flags)"""


def _sanity_cells() -> str:
    resin = " OR ".join(f"contains(lower(v), '{w}')" for w in RESIN_WORDS)
    desc = " OR ".join(f"contains(lower(v), '{w}')" for w in DESCRIPTION_WORDS)
    fields = ("part_number", "description", "material", "cycle_time_sec", "ops_labour", "labour_rate", "weight_g", "annual_volume")
    rows = " UNION ALL ".join(f"SELECT l_orderkey, '{f}' AS field, trim(CAST({f} AS STRING)) AS v FROM items" for f in fields)
    return rf"""{ITEM_ROWS}, cells AS ({rows}), nums AS (SELECT *, TRY_CAST(v AS DOUBLE) AS x FROM cells), judged AS (SELECT l_orderkey, field,
 CASE WHEN v IS NULL OR v = '' OR (field IN ('ops_labour', 'labour_rate', 'cycle_time_sec', 'weight_g', 'annual_volume') AND x IS NULL) THEN 'red'
 WHEN field = 'material' AND upper(v) = 'NO MAT IDENTIFIED' THEN 'yellow'
 WHEN field = 'material' AND (regexp_matches(v, '^\d{{5,}}$') OR regexp_matches(v, '^[A-Z0-9]{{2,6}}[-_][A-Z0-9]{{3,}}$')) AND NOT ({resin}) THEN 'red'
 WHEN field = 'ops_labour' AND (x < 0 OR x > 2) THEN 'red' WHEN field = 'ops_labour' AND x > 1 THEN 'yellow'
 WHEN field = 'labour_rate' AND x <= 0 THEN 'red' WHEN field = 'labour_rate' AND (x > 33 OR x < 15) THEN 'yellow'
 WHEN field = 'part_number' AND (len(string_split_regex(v, '\s+')) >= 3 OR {desc} OR length(v) > 40) THEN 'red'
 WHEN field = 'description' AND regexp_matches(v, '^\d{{6,}}$') THEN 'red' WHEN field = 'cycle_time_sec' AND x <= 0 THEN 'red'
 WHEN field = 'weight_g' AND (x <= 0 OR x > 5000) THEN 'yellow' WHEN field = 'annual_volume' AND (x <= 0 OR x > 10000000) THEN 'yellow' ELSE 'clean' END AS severity FROM nums)"""


LABEL_CELLS = f"""cells AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS sheet, CAST(p_partkey AS BIGINT) AS ord, CAST(floor(p_partkey / 50 % 20 + 1) AS INT) AS row,
 CAST(1 + 3 * floor(p_partkey / 1000) AS INT) AS col, {q.LABELS} AS v_str FROM part UNION ALL
 SELECT p_partkey % 50, p_partkey + 1000000, CAST(floor(p_partkey / 50 % 20 + 1) AS INT), CAST(2 + 3 * floor(p_partkey / 1000) + p_partkey % 2 AS INT), concat('v', CAST(p_partkey AS STRING)) FROM part)"""


def _labels() -> str:
    words = ", ".join(f"('{f}', '{k}')" for f, kws in ANCHORS.items() for k in kws)
    out = {name: o for name, _, o, _ in HEADERS}
    holds = lambda ws: " OR ".join(f"contains(n, '{w}')" for w in ws)
    other = " OR ".join(_kw("n", k) for k in (*DRAWING_ANCHORS, *ITEM_LABELS))
    return f"""WITH {LABEL_CELLS}, words(field, k) AS (VALUES {words}), near AS (SELECT *, {_norm('v_str')} AS n FROM cells WHERE row < 150 AND col < 20),
 labels AS (SELECT DISTINCT sheet, ord, row, col, field FROM near JOIN words ON n = k OR starts_with(n, k || ' ') OR ends_with(n, ' ' || k)
  WHERE NOT (field = 'part_number' AND ({other})) AND NOT (field = 'description' AND ({holds(out['description'])})) AND NOT (field = 'material' AND ({holds(out['material_generic'])}))),
 tries(try_no, skip, dr, dc) AS (VALUES (1, 0, 0, 1), (1, 1, 0, 2), (1, 2, 0, 3), (2, 0, 0, 2), (2, 1, 0, 3), (2, 2, 0, 4), (3, 0, 1, 0))"""


def _anchor_best() -> str:
    return f"""{_labels()},
 first AS (SELECT l.sheet, field, l.ord, try_no, c.v_str AS value, c.row AS t_row, c.col AS t_col FROM labels l, tries t JOIN cells c ON c.sheet = l.sheet AND c.row = l.row + dr AND c.col = l.col + dc
  QUALIFY row_number() OVER (PARTITION BY l.sheet, field, l.ord, try_no ORDER BY skip, c.row, c.col, c.v_str) = 1)
 SELECT sheet, field, value, t_row, t_col FROM first WHERE starts_with(value, 'v') QUALIFY row_number() OVER (PARTITION BY sheet, field ORDER BY try_no, ord, value, t_row, t_col) = 1"""


def _merged_targets() -> str:
    """Labels stand in no range here; a range is one row of two columns behind a label's column."""
    return f"""{_labels()}, ranges AS (SELECT DISTINCT CAST(p_partkey % 50 AS BIGINT) AS sheet, CAST(floor(p_partkey / 50 % 20 + 1) AS INT) AS row, CAST(2 + 3 * floor(p_partkey / 1000) AS INT) AS c1 FROM part),
 spot AS (SELECT l.*, try_no, l.row + dr AS r, l.col + dc AS c, c.v_str IS NULL AS blank, skip FROM labels l CROSS JOIN tries t LEFT JOIN cells c ON c.sheet = l.sheet AND c.row = l.row + dr AND c.col = l.col + dc),
 one AS (SELECT DISTINCT * EXCLUDE (blank, skip) FROM spot QUALIFY rank() OVER (PARTITION BY sheet, field, ord, try_no ORDER BY blank, skip) = 1),
 moved AS (SELECT o.sheet, field, o.row, o.col, o.ord, try_no, r, coalesce(c1, c) AS c FROM one o LEFT JOIN ranges g ON g.sheet = o.sheet AND g.row = o.r AND o.c BETWEEN g.c1 AND g.c1 + 1)
 SELECT m.sheet, field, m.row, m.col, m.ord, CAST(try_no AS INT) AS try_no, min(v_str) AS value, CAST(r AS INT) AS t_row, CAST(c AS INT) AS t_col FROM moved m JOIN cells v ON v.sheet = m.sheet AND v.row = m.r AND v.col = m.c GROUP BY ALL"""


def _labour_rate() -> str:
    named = " OR ".join([_kw("n", k) for k in RATE_ANCHORS] + [f"contains(n, '{w}')" for w in RATE_PARTS])
    below = " OR ".join(f"contains(b.n, '{w}')" for w in RATE_BELOW)
    return f"""WITH cells AS (SELECT *, {_norm('v')} AS n FROM (SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS sheet, CAST(p_partkey AS BIGINT) AS ord, CAST(floor(p_partkey / 3) % 4 + 1 AS INT) AS row, CAST(p_partkey % 3 + 1 AS INT) AS col, {q.RATE_TEXT} AS v FROM part)),
 labels AS (SELECT * FROM cells a WHERE ({named}) OR (n IN ('labour', 'labor') AND EXISTS (SELECT 1 FROM cells b WHERE b.sheet = a.sheet AND b.row = a.row + 1 AND b.col = a.col AND ({below})))),
 tries(try_no, dr, dc) AS (VALUES (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 0, 1), (5, 0, 2))
 SELECT l.sheet, CAST(replace(c.v, '$', '') AS DOUBLE) AS rate, c.row AS t_row, c.col AS t_col FROM labels l, tries JOIN cells c ON c.sheet = l.sheet AND c.row = l.row + dr AND c.col = l.col + dc
 WHERE starts_with(c.v, '$') QUALIFY row_number() OVER (PARTITION BY l.sheet ORDER BY l.ord, try_no) = 1"""


def _categories(n: str) -> dict[str, str]:
    hit = {name: "(" + " OR ".join(_kw(n, k) for k in kws) + ")" for name, kws, _, _ in HEADERS}
    for name, _, out, _ in HEADERS:
        if out:
            hit[name] = f"({hit[name]} AND NOT (" + " OR ".join(f"contains({n}, '{x}')" for x in out) + "))"
    tool = "(" + hit["tool"] + " OR " + " OR ".join(f"contains({n}, '{k}')" for k in HEADERS[0][1]) + ")"
    bare = f"NOT ({hit['item']} OR {tool} OR {hit['drawing']} OR {hit['description']})"
    hit["part_specific"] = f"({hit['part_specific']} AND {bare})"
    hit["part_generic"] = f"({hit['part_generic']} AND {bare} AND NOT {hit['part_specific']})"
    return {k: f"({v} AND NOT {tool})" for k, v in hit.items() if k != "tool"}


def _header_cells() -> str:
    cats = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _categories("norm").items())
    return f"""cells AS (SELECT *, {_norm('raw')} AS norm FROM (SELECT CAST(floor(p_partkey / 48) AS BIGINT) AS sheet, CAST(floor(p_partkey / 12) % 4 AS INT) AS row,
 CAST(p_partkey % 12 + 1 AS INT) AS col, {q.HEADER_TEXT} AS raw FROM part)),
 tagged AS (SELECT *, list_filter([{cats}], lambda x: x IS NOT NULL) AS cats FROM cells),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY sheet, row ORDER BY col) AS i FROM tagged WHERE len(cats) > 0)"""


def _header_pick() -> str:
    """Slots by a recursive walk over the cells of a row."""
    has = lambda *n: "(" + " OR ".join(f"list_contains(taken, '{x}')" for x in n) + ")"
    point = {n: s for n, _, _, s in HEADERS}
    score = " + ".join(
        [f"CASE WHEN {has('part_specific')} THEN 35 WHEN {has('part_generic')} THEN 10 ELSE 0 END", f"CASE WHEN {has('material_grade', 'material_generic')} THEN 15 ELSE 0 END"]
        + [f"CASE WHEN {has(n)} THEN {point[n]} ELSE 0 END" for n in ("cycle_time", "description", "ops", "weight", "volume", "quote", "item", "drawing")]
    )
    return f"""WITH RECURSIVE {_header_cells()}, walk AS (SELECT sheet, row, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST([] AS INT[]) AS "at" FROM (SELECT DISTINCT sheet, row FROM ordered)
  UNION ALL SELECT w.sheet, w.row, o.i, CASE WHEN len(f.free) > 0 THEN list_append(w.taken, f.free[1]) ELSE w.taken END, CASE WHEN len(f.free) > 0 THEN list_append(w."at", o.col) ELSE w."at" END
  FROM walk w JOIN ordered o ON o.sheet = w.sheet AND o.row = w.row AND o.i = w.i + 1, LATERAL (SELECT list_filter(o.cats, lambda x: NOT list_contains(w.taken, x)) AS free) f),
 ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY sheet, row ORDER BY i DESC) = 1),
 scored AS (SELECT *, {score} AS score FROM ends WHERE {has('part_specific', 'part_generic')} AND {has('cycle_time', 'quote', 'item')}),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY score DESC, row) = 1)"""


def _header_data() -> str:
    """The look below each header, a row at a time."""
    col = lambda x: f"""s."at"[list_position(s.taken, '{x}')]"""
    named = "b.col % 5 = 0"
    data = f"(b.col = coalesce({col('part_specific')}, {col('part_generic')}) OR b.col = {col('cycle_time')}) AND ({named} OR b.sheet > 0) OR b.col = {col('quote')} AND {named}"
    return f"""{_header_pick()}, body AS (SELECT DISTINCT sheet, CAST(row * 2 + 3 AS INT) AS row, col FROM cells),
 ahead AS (SELECT s.sheet, s.row, d.dr, count(b.col) = 0 AS blank, coalesce(bool_or({data}), false) AS data FROM scored s CROSS JOIN (SELECT unnest(range(1, 26)) AS dr) d LEFT JOIN body b ON b.sheet = s.sheet AND b.row = s.row + d.dr GROUP BY 1, 2, 3),
 look AS (SELECT sheet, row, CAST(0 AS BIGINT) AS dr, 0 AS found, 0 AS blanks, false AS ended FROM scored
  UNION ALL SELECT l.sheet, l.row, a.dr, CASE WHEN a.data AND NOT l.ended THEN l.found + 1 ELSE l.found END, CASE WHEN a.blank THEN l.blanks + 1 ELSE 0 END,
   l.ended OR (a.blank AND (l.blanks + 1 >= 4 OR (l.found > 0 AND l.blanks + 1 >= 2))) FROM look l JOIN ahead a ON a.sheet = l.sheet AND a.row = l.row AND a.dr = l.dr + 1)
 SELECT sheet, row, CAST(least(found, 10) AS INT) AS n_data FROM look WHERE dr = 25"""


def _row_walk() -> str:
    p = "PARTITION BY sheet"
    to = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""WITH r AS (SELECT user_id AS sheet, ts AS row, event_id, event_type = 'error' AND event_id % 5 = 0 AS is_stop, event_type = 'signup' AND event_id % 3 = 0 AS is_empty,
 event_type = 'view' AND event_id % 4 = 0 AS is_idx, event_type <> 'click' OR event_id % 3 = 0 AS has_info, event_type <> 'click' AND event_id % 6 <> 0 AS has_part FROM events),
 s AS (SELECT *, max(CAST(has_part AND NOT is_idx AND NOT is_stop AND NOT is_empty AS INT)) OVER ({p} ORDER BY row {to}) = 1 AS started FROM r),
 k AS (SELECT *, CASE WHEN is_stop THEN 'stop' WHEN is_empty THEN 'empty' WHEN is_idx AND NOT started THEN 'idx' WHEN NOT has_info THEN 'noinfo' WHEN has_part THEN 'item' ELSE 'pass' END AS kind FROM s),
 c AS (SELECT *, sum(CAST(kind = 'item' AS INT)) OVER ({p} ORDER BY row {to}) AS cnt, sum(CAST(kind = 'idx' AS INT)) OVER ({p} ORDER BY row {to}) AS seg FROM k),
 e AS (SELECT *, sum(CAST(kind = 'empty' AS INT)) OVER ({p}, cnt, seg ORDER BY row {to}) AS emp, sum(CAST(kind = 'noinfo' AS INT)) OVER ({p}, cnt ORDER BY row {to}) AS noi FROM c),
 b AS (SELECT *, max(CAST(kind = 'stop' OR (kind = 'empty' AND (cnt > 0 OR emp >= 2)) OR (cnt = 0 AND noi >= 10) OR (cnt > 0 AND noi >= 2) AS INT)) OVER ({p} ORDER BY row {to}) AS ended FROM e)
 SELECT sheet, event_id, CAST(row_number() OVER ({p} ORDER BY row) AS INT) AS item_seq FROM b WHERE ended = 0 AND kind = 'item'"""


def _ignored(n: str) -> str:
    tests = []
    for k in IGNORED_SHEETS:
        stem = k.rstrip("s")
        tests.append(f"{n} IN ('{k}', '{k}s', '{k}es') OR rtrim({n}, 's') = '{stem}' OR starts_with({n}, '{k} ') OR ends_with({n}, ' {k}') OR contains({n}, ' {k} ') OR regexp_matches({n}, '\\b{stem}s?\\b')")
    return " OR ".join(tests)


SHEETS = f"""sheets AS (SELECT *, lower(trim(title)) AS norm FROM (SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS book, CAST(p_partkey % 5 AS INT) AS sheet_idx, {q.TITLE} AS title,
 CASE WHEN p_size % 6 = 0 THEN 'hidden' ELSE 'visible' END AS state, CAST(p_size % 4 AS INT) AS n_cells, p_size % 3 = 0 AS has_cycle FROM part)),
 scored AS (SELECT *, CASE WHEN norm = 'mpc' THEN 1000 WHEN regexp_matches(norm, '^mpc[-_ ]?(quote|rfq|pricing|master)') THEN 800 - length(norm) WHEN regexp_matches(norm, '^mpc[-_ ]*[0-9]+$') THEN 400 - length(norm)
  WHEN regexp_matches(norm, '^mpc(\\b|[-_ ])') THEN 300 - length(norm) WHEN regexp_matches(norm, '\\bmpc\\b') THEN 200 - length(norm) WHEN contains(norm, 'mpc') THEN 100 - length(norm) ELSE 0 END AS m,
 CASE WHEN norm IN ('qinfo', 'quote info', 'quoteinfo', 'q-info', 'quote_info') THEN 1000 WHEN regexp_matches(norm, '^(q|quote)[-_ ]?info\\b') THEN 500 - length(norm)
  WHEN regexp_matches(norm, '\\b(qinfo|quote info|quoteinfo|q-info)\\b') THEN 300 - length(norm) WHEN contains(norm, 'qinfo') OR contains(norm, 'quote info') OR contains(norm, 'quoteinfo') THEN 100 - length(norm) ELSE 0 END AS q,
 ({_ignored('norm')}) AS off FROM sheets)"""

LINK = f"""quotes AS (SELECT CAST(p_partkey AS BIGINT) AS quote_ord, {q.PART_TEXT} AS part_number, CASE WHEN p_partkey % 3 = 0 THEN concat('DRW', CAST(p_partkey AS STRING), 'X') ELSE '' END AS drawing_number FROM part),
 qp AS (SELECT quote_ord, part_number AS p FROM quotes WHERE trim(part_number) <> '' UNION ALL SELECT quote_ord, drawing_number FROM quotes WHERE trim(drawing_number) <> ''),
 qk AS (SELECT DISTINCT * FROM (SELECT quote_ord, 'exact' AS kind, lower(trim(p)) AS key FROM qp UNION ALL SELECT quote_ord, 'norm', {_np('p')} FROM qp UNION ALL SELECT quote_ord, 'token', unnest({_tokens('p')}) FROM qp) WHERE key <> ''),
 jobs AS (SELECT DISTINCT concat(CAST(l_partkey AS STRING), '/', part_number) AS job_ord, part_number FROM (SELECT l_partkey, {q.JOB_PART} AS part_number FROM lineitem)),
 jk AS (SELECT job_ord, 1 AS tier, 0 AS pos, 'exact' AS kind, lower(trim(part_number)) AS key FROM jobs UNION ALL SELECT job_ord, 2, 0, 'norm', {_np('part_number')} FROM jobs
  UNION ALL SELECT job_ord, 3, list_position({_all_tokens('part_number')}, key), 'token', key FROM (SELECT job_ord, part_number, unnest({_tokens('part_number')}) AS key FROM jobs)),
 best AS (SELECT job_ord, tier, kind, key FROM (SELECT DISTINCT j.* FROM jk j JOIN qk USING (kind, key)) QUALIFY row_number() OVER (PARTITION BY job_ord ORDER BY tier, pos, kind, key) = 1),
 cand AS (SELECT kind, key, list(quote_ord ORDER BY quote_ord) AS cands FROM qk GROUP BY kind, key),
 ordered AS (SELECT b.*, cands, row_number() OVER (ORDER BY job_ord) AS i FROM best b JOIN cand USING (kind, key)),
 walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick
  UNION ALL SELECT o.i, list_append(w.used, p.p), p.p FROM walk w JOIN ordered o ON o.i = w.i + 1, LATERAL (SELECT coalesce(list_filter(o.cands, lambda x: NOT list_contains(w.used, x))[1], o.cands[1]) AS p) p),
 linked AS (SELECT j.job_ord, j.part_number, o.tier, w.pick AS quote_ord FROM jobs j LEFT JOIN ordered o USING (job_ord) LEFT JOIN walk w ON w.i = o.i)"""


def _contract() -> str:
    num = "regexp_extract({b}, '([0-9]+(?:[.][0-9]+)?)', 1)"
    whole = "CASE WHEN regexp_full_match({b}, '[+-]?[0-9]+[.]?[0-9]*') THEN try_cast({b} AS DOUBLE) END"
    first = f"try_cast(nullif({num}, '') AS DOUBLE)"
    bare = lambda units: f"trim(regexp_replace(low, '[ ]*(?:{units})[ ]*$', ''))"
    ok = lambda v: f"CASE WHEN NOT starts_with(low, '#') THEN {_r2(v)} END"
    of = lambda text, b: text.replace("{b}", b)
    c = ok(of(whole, bare("seconds?|secs?|s")))
    o = ok(of(f"coalesce({whole}, {first})", bare("ops|labour|labor|operators?")))
    r = ok(of(first, "regexp_replace(low, '[$,]', '', 'g')"))
    w = ok(of(f"coalesce({whole}, {first})", bare("grams?|g")))
    return f"""SELECT raw, n, {c} AS cycle_time_sec, {o} AS ops_labour, {r} AS labour_rate, CASE WHEN {w} > 0 THEN {w} END AS weight_g
FROM (SELECT raw, count(*) AS n, lower(trim(raw)) AS low FROM (SELECT {q.CELL_TEXT} AS raw FROM lineitem) GROUP BY raw)"""


def oracle_sql() -> dict[str, str]:
    letter = lambda x: f"chr(CAST(65 + {x} AS INT))"
    coord = f"concat(CASE WHEN c > 702 THEN {letter('floor((c - 703) / 676)')} ELSE '' END, CASE WHEN c > 26 THEN {letter('floor((c - 27) / 26) % 26')} ELSE '' END, {letter('(c - 1) % 26')}, CAST(r AS STRING))"
    return {
        "norm_text": f"SELECT p_partkey, {_norm('''concat('  ', p_name, chr(160), ' : ;')''')} AS norm FROM part",
        "clean_part_no": _clean_part(),
        "clean_numbers": _clean_numbers(),
        "typed_numbers": f"SELECT l_orderkey, l_linenumber, l_partkey, v, CASE WHEN v > 0 THEN {_r2('v')} END AS cycle_time, {_r2('v')} AS ops, {_r2('v')} AS currency, CASE WHEN v > 0 THEN {_r2('v')} END AS weight, CASE WHEN v > 0 THEN CAST(round_even(v, 0) AS BIGINT) END AS volume FROM (SELECT *, {q.TYPED} AS v FROM lineitem)",
        "clean_texts": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Clip' WHEN 1 THEN regexp_replace(p_name, '^[ :;-]+|[ :;-]+$', '', 'g') WHEN 3 THEN concat('a  b', CAST(p_size AS STRING)) END AS text FROM part",
        "coord_roundtrip": f"SELECT p_partkey, {coord} AS coord, c AS col, r AS row FROM (SELECT p_partkey, CAST(p_partkey % 16384 + 1 AS INT) AS c, p_size AS r FROM part)",
        "coord_split": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'My Sheet' WHEN 1 THEN 'Current Sheet' ELSE 'N/A' END AS sheet, CASE p_partkey % 3 WHEN 0 THEN concat('B', CAST(p_size AS STRING)) WHEN 1 THEN concat('C', CAST(p_size AS STRING)) ELSE 'N/A' END AS cell FROM part",
        "resolve_item_no": _resolve(),
        "norm_part_no": f"SELECT p_partkey, {_np('raw')} AS key FROM (SELECT p_partkey, {q.PART_TEXT} AS raw FROM part)",
        "part_tokens": f"SELECT p_partkey, unnest({_tokens('raw')}) AS token FROM (SELECT p_partkey, {q.PART_TEXT} AS raw FROM part)",
        "stop_words": _stop(),
        "validate_conf": f"WITH {ITEM_ROWS}, {RULES} SELECT confidence, CAST(n_warnings AS INT) AS n_warnings, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM rated GROUP BY 1, 2",
        "overall_conf": f"WITH {ITEM_ROWS}, {RULES} SELECT l_orderkey, CASE WHEN bool_or(confidence = 'low') THEN 'low' WHEN bool_or(confidence = 'medium') THEN 'medium' ELSE 'high' END AS confidence, count(*) AS items FROM rated GROUP BY 1",
        "sanity_summary": f"WITH {_sanity_cells()} SELECT field, severity, count(*) AS n FROM judged GROUP BY 1, 2",
        "row_flags": f"WITH {_sanity_cells()} SELECT l_orderkey, max(CASE severity WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END) AS worst, count(*) FILTER (severity = 'red') AS red, count(*) FILTER (severity = 'yellow') AS yellow FROM judged GROUP BY 1",
        "sheet_extent": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row FROM documents),
 w AS (SELECT doc_id, row, unnest(string_split(line, ' ')) AS v, generate_subscripts(string_split(line, ' '), 1) AS col FROM l)
 SELECT doc_id, CAST(max(row) AS INT) AS max_row, CAST(max(col) AS INT) AS max_col FROM w WHERE v <> '' AND trim(v) <> '' GROUP BY 1""",
        "anchor_best": _anchor_best(),
        "merged_targets": _merged_targets(),
        "frame_rows": f"WITH {ITEM_ROWS}, {RULES} SELECT quote_item_number, coalesce(part_number, '') AS part_number, description, coalesce(material, '') AS material, cycle_time_sec, ops_labour, labour_rate, weight_g, annual_volume, confidence, '' AS source_file, '' AS quote_id, " + ", ".join(f"'' AS {c}" for c in EXPORT_COLUMNS if c.endswith("_coord")) + " FROM rated",
        "key_figures": f"WITH {ITEM_ROWS}, {RULES} SELECT l_orderkey, coalesce(nullif(regexp_extract(first(quote_item_number ORDER BY l_linenumber, l_partkey, l_suppkey, weight_g), '^(Q[0-9]{{4,5}})', 1), ''), 'N/A') AS quote_id, count(*) AS total_items, CASE WHEN bool_or(confidence = 'low') THEN 'LOW' WHEN bool_or(confidence = 'medium') THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM rated GROUP BY 1",
        "doc_roundtrip": f"SELECT {q.ITEMS} FROM lineitem",
        "merged_cells": f"""WITH {LABEL_CELLS}, m AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS sheet, CAST(p_partkey AS BIGINT) AS merge_ord, CAST(floor(p_partkey / 50 % 20 + 1) AS INT) AS min_row,
 CAST(floor(p_partkey / 50 % 20 + 2) AS INT) AS max_row, CAST(p_size % 4 + 1 AS INT) AS min_col, CAST(p_size % 4 + 3 AS INT) AS max_col FROM part),
 d AS (SELECT DISTINCT sheet, row, col FROM cells) SELECT d.sheet, d.row, d.col, merge_ord, min_row AS top_row, min_col AS top_col FROM d JOIN m ON d.sheet = m.sheet AND d.row BETWEEN min_row AND max_row AND d.col BETWEEN min_col AND max_col
 QUALIFY row_number() OVER (PARTITION BY d.sheet, d.row, d.col ORDER BY merge_ord) = 1""",
        "labour_rate": _labour_rate(),
        "header_classify": "SELECT p_partkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _categories("n").items()) + f"], lambda x: x IS NOT NULL), ',') AS categories FROM (SELECT p_partkey, {_norm('raw')} AS n FROM (SELECT p_partkey, {q.LABELS} AS raw FROM part))",
        "header_pick": f"{_header_pick()} SELECT sheet, row AS header_row, CAST(score AS INT) AS score FROM best",
        "index_rows": """WITH d AS (SELECT DISTINCT l_orderkey AS sheet, l_suppkey AS row, l_linenumber AS col, CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber ELSE l_quantity END AS INT)::DOUBLE AS v FROM lineitem WHERE NOT (l_linenumber = 1 AND l_suppkey % 5 = 0)),
 s AS (SELECT *, v - lag(v) OVER (PARTITION BY sheet, row ORDER BY col) AS step, v = floor(v) AND v BETWEEN 0 AND 100 AS small FROM d),
 g AS (SELECT sheet, row, bool_and(small) AS ok, count(*) AS n, count(*) FILTER (v = col) AS own, min(v) AS least, coalesce(bool_and(step = 1), false) AS runs FROM s GROUP BY 1, 2)
 SELECT sheet, row FROM g WHERE n >= 2 AND ok AND (own >= 2 OR (runs AND least IN (0, 1, 2)) OR (runs AND n >= 3))""",
        "row_walk": _row_walk(),
        "pivot_slots": f"""{_header_pick()}, slot AS (SELECT sheet, row AS header_row, unnest(taken) AS cat, unnest("at") AS col FROM best)
 SELECT c.sheet, c.row + 10 AS row, max(CASE WHEN s.cat = 'part_specific' THEN c.raw || '!' END) AS part_specific, max(CASE WHEN s.cat = 'cycle_time' THEN c.raw || '!' END) AS cycle_time, max(CASE WHEN s.cat = 'quote' THEN c.raw || '!' END) AS quote
 FROM cells c JOIN best b ON b.sheet = c.sheet LEFT JOIN slot s ON s.sheet = c.sheet AND s.col = c.col GROUP BY 1, 2""",
        "dedupe_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1",
        "sheet_rank": f"WITH {SHEETS} SELECT book, sheet_idx, CAST(m AS INT) AS score, CAST(row_number() OVER (PARTITION BY book ORDER BY m DESC, sheet_idx) AS INT) AS rank FROM scored WHERE m > 0",
        "candidate_sheets": f"""WITH {SHEETS}, seen AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY q DESC, sheet_idx) AS rq, row_number() OVER (PARTITION BY book ORDER BY m DESC, sheet_idx) AS rm FROM scored WHERE state = 'visible' AND n_cells > 0 AND NOT off),
 b AS (SELECT book, max(q) > 0 AS hq, max(m) > 0 AS hm, bool_or(has_cycle) FILTER (rq = 1) AS cq, bool_or(has_cycle) FILTER (rm = 1) AS cm,
  min(sheet_idx) FILTER (q > 0 AND norm IN ('qinfo', 'quote info', 'quoteinfo', 'q-info', 'quote_info')) AS eq, min(sheet_idx) FILTER (m > 0 AND norm IN ('mpc', 'mpc quote', 'mpc quotes', 'mpc_quote', 'mpc-quote', 'mpc rfq')) AS em,
  count(*) FILTER (q > 0) > 1 AND bool_and(regexp_matches(norm, '\\b(item|qinfo|quote\\s*info|part)[-_ ]*[0-9]+\\b')) FILTER (q > 0) AS aq,
  count(*) FILTER (m > 0) > 1 AND bool_and(regexp_matches(norm, '\\b(item|mpc|part)[-_ ]*[0-9]+\\b')) FILTER (m > 0) AS am FROM seen GROUP BY book)
 SELECT book, sheet_idx, title FROM seen JOIN b USING (book) WHERE CASE WHEN hq AND hm AND NOT cq AND cm THEN CASE WHEN em IS NULL THEN rm = 1 ELSE sheet_idx = em END
  WHEN hq THEN CASE WHEN eq IS NOT NULL THEN sheet_idx = eq WHEN aq THEN q > 0 ELSE rq = 1 END WHEN hm THEN CASE WHEN em IS NOT NULL THEN sheet_idx = em WHEN am THEN m > 0 ELSE rm = 1 END ELSE true END""",
        "tab_numbers": f"""WITH {SHEETS}, a AS (SELECT book, sheet_idx, title, CASE WHEN sheet_idx = 1 THEN concat('Q', CAST(2000 + book AS STRING), '-R1-', CAST(n_cells AS STRING)) WHEN sheet_idx = 2 THEN concat('Q', CAST(3000 + book AS STRING)) END AS found,
  CASE WHEN book % 3 > 0 THEN concat('Q', CAST(1000 + book AS STRING)) END AS base, nullif(regexp_extract(title, '(?i)\\b(item|mpc|qinfo|quote\\s*info|part)[-_ ]*([0-9]+)\\b', 2), '') AS n FROM sheets)
 SELECT book, sheet_idx, CASE WHEN regexp_matches(found, '^Q[0-9]{{4,5}}-') THEN found WHEN regexp_matches(title, '^Q[0-9]{{4,5}}-[0-9]+$') THEN title
  ELSE concat(coalesce(base, found, 'Q0000'), '-', coalesce(n, CAST(sheet_idx + 1 AS STRING))) END AS quote_item_number FROM a""",
        "link_tiers": f"WITH RECURSIVE {LINK} SELECT job_ord, tier, key FROM best",
        "link_jobs": f"WITH RECURSIVE {LINK} SELECT job_ord, CASE WHEN tier IS NULL THEN 'unmatched' ELSE 'matched' END AS status, coalesce(['exact', 'normalized', 'token', 'job token'][tier], 'none') AS match_type, coalesce(['exact', 'normalized', 'normalized', 'normalized'][tier], 'none') AS confidence, quote_ord FROM linked",
        "unlinked_quotes": f"WITH RECURSIVE {LINK} SELECT quote_ord, part_number FROM quotes WHERE quote_ord NOT IN (SELECT quote_ord FROM linked WHERE quote_ord IS NOT NULL)",
        "link_summary": f"WITH RECURSIVE {LINK} SELECT count(*) AS total_jobs, count(*) FILTER (tier IS NOT NULL) AS matched_jobs, count(*) FILTER (tier IS NULL) AS unmatched_jobs, (SELECT count(*) FROM quotes WHERE quote_ord NOT IN (SELECT quote_ord FROM linked WHERE quote_ord IS NOT NULL)) AS unmatched_quotes FROM linked",
        "flat_rows": f"""WITH {ITEM_ROWS}, {RULES} SELECT concat_ws('; ', CASE WHEN w1 = 1 THEN 'Missing cycle_time_sec' WHEN w2 = 1 THEN concat('Cycle time ', CAST(cycle_time_sec AS STRING), 's outside expected range (5.0s–300.0s)') END,
 CASE WHEN w3 = 1 THEN 'Missing part_number' END, CASE WHEN w4 = 1 THEN concat('#Ops / Labour ', CAST(ops_labour AS STRING), ' outside expected range (0.0–1.0)') END,
 CASE WHEN w5 = 1 THEN concat('Weight ', CAST(weight_g AS STRING), 'g outside expected range (>0g)') END, CASE WHEN w6 = 1 THEN concat('Annual volume ', CAST(annual_volume AS STRING), ' outside expected range (>0)') END,
 CASE WHEN w7 = 1 THEN concat('Non-standard quote item number format: ', quote_item_number) END) AS warnings, confidence, coalesce(material, '') AS material, count(*) AS n FROM rated GROUP BY 1, 2, 3""",
        "doc_totals": f"WITH {ITEM_ROWS} SELECT l_orderkey, count(*) AS total_items, regexp_extract(first(quote_item_number ORDER BY l_linenumber, l_partkey, l_suppkey, weight_g), '^(Q[0-9]{{4,5}})', 1) AS quote_id FROM items GROUP BY 1",
        "job_text_parse": "SELECT CAST(o_orderkey AS BIGINT) AS line_no, concat('J', CAST(o_orderkey AS STRING)) AS job_number, CASE WHEN o_orderkey % 5 = 3 THEN '' ELSE concat('P', CAST(o_custkey AS STRING)) END AS part_number FROM orders",
        "contract_values": _contract(),
        "header_data": _header_data(),
        "target_sheets": f"SELECT p_partkey, title, regexp_matches(lower(title), '(^|[^a-z0-9_])mpc([^a-z0-9_]|$)|^mpc|(^|[ _-])mpc([ _-]|$)|(^|[^a-z0-9_])(q|quote)[-_ ]?info([^a-z0-9_]|$)') AS is_target FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('old_', CAST(p_partkey % 9 AS STRING), '_mpc') WHEN 1 THEN p_name ELSE {q.TITLE} END AS title FROM part)",
        "display_rows": f"SELECT coalesce(description, '') AS description, coalesce(material, '') AS material, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'Q: S!A1, ' ELSE '' END, 'PN: B', CAST(l_linenumber AS STRING)) AS coords, concat('a', coalesce('; ' || material, '')) AS warnings, count(*) AS n FROM (SELECT {q.ITEMS} FROM lineitem) GROUP BY 1, 2, 3, 4",
        "coords_parse": "SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'S!A1' END AS quote_num, concat('B', CAST(l_linenumber AS STRING)) AS part_num, CAST(NULL AS STRING) AS weight_g, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
        "number_formats": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN format('${:.2f}', o_custkey / 4) ELSE '-' END AS rate, format('{:.2f}', o_custkey / 4) AS weight, format('{:,}', CAST(o_orderkey * 1000 AS BIGINT)) AS volume FROM orders",
        "canonical_items": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('Q', CAST(o_custkey AS STRING), '-1') ELSE concat('Q', CAST(o_orderkey AS STRING), '-1') END AS quote_item_number, 'PN 1' AS part_number, CAST(NULL AS STRING) AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'PA66' END AS material, o_orderkey % 50 + 0.25::DOUBLE AS cycle_time_sec, CAST(NULL AS DOUBLE) AS ops_labour, CAST(o_orderkey % 9 AS BIGINT) AS annual_volume, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, 'a|b' AS warnings FROM orders",
        "linked_rows": f"WITH RECURSIVE {LINK} SELECT l.job_ord, j.part_number AS part, coalesce('Q' || CAST(l.quote_ord AS STRING), '') AS item, CAST(l.quote_ord AS DOUBLE) AS cycle, CASE WHEN l.tier IS NULL THEN '🔴 Job without Quote' ELSE '🟢 Matched' END AS status, coalesce(['EXACT', 'NORMALIZED', 'NORMALIZED', 'NORMALIZED'][l.tier], 'NONE') AS confidence FROM linked l JOIN jobs j USING (job_ord)",
        "run_metrics": f"WITH {ITEM_ROWS}, {RULES}, d AS (SELECT l_orderkey, count(*) AS n, sum(n_warnings) AS w FROM rated GROUP BY 1) SELECT count(*) AS files, count(*) FILTER (n > 0) AS quotes, CAST(sum(n) AS BIGINT) AS items, CAST(sum(w) AS BIGINT) AS warnings, count(*) FILTER (l_orderkey % 97 = 0) AS failed_files FROM d",
    }
