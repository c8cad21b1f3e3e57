"""Chat formatting with minimum-cost role repair.

Legal conversations are [system] (user assistant)+. Each message may keep its role, take another
(relabel), join the turn before it (merge), or be preceded by empty turns (insert). The cheapest
sequence of such choices is found by dynamic programming over the automaton of last roles. A message
is a 4 x 4 matrix of costs between states, and sequences multiply in the (min, +) algebra, so a
conversation that is too long for one task is cut into ranges, whose products say in which state
each range begins and ends in the cheapest repair of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, tune

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Fixed costs of a repair.
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
FAR = 1 << 40
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _routes() -> dict[tuple[int, int], list[int]]:
    """For states (from, to) the fewest empty turns that must stand between, as roles."""
    out = {}
    for a in range(4):
        level = [(s, []) for s in _NEXT[a]]
        while level:
            nxt = []
            for s, way in level:
                if (a, s) not in out:
                    out[a, s] = way
                    nxt += [(t, [*way, s]) for t in _NEXT[s]]
            level = nxt
    return out


_ROUTE = _routes()


def role_of(role: str | None) -> int:
    """1 to 3 for a known role, else 0."""
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES[1:] else 0


def _choices(role: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) to (cost, choice) for one message; choices in order of preference."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            wrong = (UNKNOWN if not role else RELABEL) if role != b else 0
            options = []
            if (a, b) in _ROUTE:
                options.append((INSERT * len(_ROUTE[a, b]) + wrong, "emit"))
            if a == b:
                options.append((MERGE + wrong, "merge"))
            if options:
                out[a, b] = min(options, key=lambda x: x[0])
    return out


CHOICES = [_choices(r) for r in range(4)]
FINAL = [0, 2 * INSERT, INSERT, 0]  # empty turns to end on an assistant's
_MATRIX = np.full((4, 4, 4), FAR, np.int64)
for _r in range(4):
    for (_a, _b), (_cost, _) in CHOICES[_r].items():
        _MATRIX[_r, _a, _b] = _cost


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(FAR, (x[:, :, None] + y[None, :, :]).min(1))


def identity() -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(m, 0)
    return m


def repair(roles: list[int], start: int = START, end: int | None = None) -> tuple[int, list[tuple[int, int, str]]]:
    """Least cost and (state before, state after, choice) of each message; ``end``: the state after the last."""
    cost = [FAR] * 4
    cost[start] = 0
    back: list[list[int]] = []
    for r in roles:
        nxt, frm = [FAR] * 4, [0] * 4
        for (a, b), (c, _) in CHOICES[r].items():
            if cost[a] + c < nxt[b]:
                nxt[b], frm[b] = cost[a] + c, a
        cost = nxt
        back.append(frm)
    if end is None:
        end = min(range(4), key=lambda s: (cost[s] + FINAL[s], s))
        total = cost[end] + FINAL[end]
    else:
        total = cost[end]
    out, s = [], end
    for r, frm in zip(reversed(roles), reversed(back)):
        a = frm[s]
        out.append((a, s, CHOICES[r][a, s][1]))
        s = a
    return total, out[::-1]


def head(state: int) -> str:
    return f"<|{ROLES[state]}|>\n"


TAIL = "\n<|end|>\n"


def render(texts: list[str], steps: list[tuple[int, int, str]], first: bool, last: bool) -> list[str]:
    """A piece for each message; the pieces of a conversation laid end to end are its rendering."""
    out = []
    for i, (text, (a, b, choice)) in enumerate(zip(texts, steps)):
        if choice == "merge":
            piece = "\n" + text
        else:
            piece = ("" if a == START else TAIL) + "".join(head(s) + TAIL for s in _ROUTE[a, b]) + head(b) + text
        if last and i == len(texts) - 1:
            piece += TAIL + {SYSTEM: head(USER) + TAIL + head(ASSISTANT) + TAIL, USER: head(ASSISTANT) + TAIL}.get(b, "")
        out.append(piece)
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range the products of its first and last conversation."""
    seen: list[list] = []  # range, conversation, product; the first two and the last of each range
    for batch in batches:
        for seg, conv, role in zip(*(batch.column(c).to_pylist() for c in ("seg", "conv", "role"))):
            if not seen or seen[-1][0] != seg or seen[-1][1] != conv:
                if len(seen) > 1 and seen[-2][0] == seen[-1][0] == seg and seen[-1][3]:
                    seen.pop()
                inner = bool(seen) and seen[-1][0] == seg
                seen.append([seg, conv, identity(), inner])
            seen[-1][2] = product(seen[-1][2], _MATRIX[role_of(role)])
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in seen], pa.int32()), pa.array([s[1] for s in seen], pa.string()),
             pa.array([s[3] for s in seen], pa.bool_()), pa.array([s[2].ravel().tolist() for s in seen], pa.list_(pa.int64()))],
            ["seg", "conv", "inner", "product"],
        )


def _joints(rows: list[tuple[int, str | None, list[int]]]) -> dict[int, tuple[dict, dict]]:
    """rows (range, conversation, product) in order, for conversations cut by range borders.

    Returns by range: states in which its first conversation begins, and in which its last ends.
    """
    begins: dict[tuple[int, str | None], int] = {}
    ends: dict[tuple[int, str | None], int] = {}
    i = 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and rows[j + 1][1] == rows[i][1] and rows[j + 1][0] > rows[j][0]:
            j += 1
        if j > i:
            cost = np.array([0, FAR, FAR, FAR], np.int64)
            costs = [cost]
            for _, _, p in rows[i : j + 1]:
                cost = np.minimum(FAR, (cost[:, None] + np.array(p, np.int64).reshape(4, 4)).min(0))
                costs.append(cost)
            s = int(np.argmin(cost + np.array(FINAL)))
            for k in range(j, i - 1, -1):
                p = np.array(rows[k][2], np.int64).reshape(4, 4)
                if k < j:
                    ends[rows[k][0], rows[k][1]] = s
                s = int(np.argmin(costs[k - i] + p[:, s]))
                if k > i:
                    begins[rows[k][0], rows[k][1]] = s
        i = j + 1
    return begins, ends


def _formatted(batches: Iterator[pa.RecordBatch], begins: dict, ends: dict) -> Iterator[pa.RecordBatch]:
    names = ("seg", "conv", "conv_id", "turn", "role", "text")
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        seg, conv = held[0][0], held[0][1]
        start, end = begins.get((seg, conv)), ends.get((seg, conv))
        _, steps = repair([role_of(r[4]) for r in held], START if start is None else start, end)
        pieces = render([r[5] or "" for r in held], steps, start is None, end is None)
        acts, roles, empty = [], [], []
        for r, (a, b, choice) in zip(held, steps):
            acts.append(choice if choice == "merge" else "keep" if role_of(r[4]) == b else "relabel")
            roles.append(ROLES[b])
            empty.append(len(_ROUTE[a, b]) if choice == "emit" else 0)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[2] for r in held], kinds[0]), pa.array([r[3] for r in held], kinds[1]), pa.array([r[4] for r in held], pa.string()),
             pa.array(roles), pa.array(acts), pa.array(empty, pa.int32()), pa.array(pieces, pa.string())],
            ["conv_id", "turn", "role", "new_role", "action", "inserted", "rendered"],
        )

    kinds = None
    for batch in batches:
        kinds = (batch.schema.field("conv_id").type, batch.schema.field("turn").type)
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held and (held[0][0], held[0][1]) != row[:2]:
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, new_role, action, inserted, rendered): every message, repaired and rendered.

    action: keep, relabel or merge; inserted: empty turns before it. ``rendered`` of all messages of
    a conversation in order, laid end to end, is its text. Messages are ordered by turn (null first),
    then role, then hash of the text; rows that agree in all three are alike. Null conv_ids are one conversation; null
    texts are empty; unknown and null roles take whatever role is cheapest. No rows: no rows.
    """
    n = tune(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys = ["conv", "turn", "role", "tie"]
    # borders are sampled from the keys and rows are ordered by them: no texts there
    some = rows.select(F.col("conv_id").cast("string").alias("conv"), "conv_id", "turn", "role", "text", F.xxhash64("text").alias("tie"))
    dealt = cut(some.repartitionByRange(n, *keys).withColumn("seg", F.spark_partition_id()), "chats")
    order = [F.col(k).asc_nulls_first() for k in ("seg", *keys)]
    slim = by_key(dealt.select("seg", *keys), n, "seg").sortWithinPartitions(*order)
    found = slim.select("seg", "conv", "role").mapInArrow(_summaries, "seg int, conv string, inner boolean, product array<long>")
    parts = sorted(((r["seg"], r["inner"], r["conv"], r["product"]) for r in found.collect()), key=lambda r: (r[0], r[1]))
    begins, ends = _joints([(s, c, p) for s, _, c, p in parts])
    full = by_key(dealt.select("seg", "conv_id", "text", *keys), n, "seg").sortWithinPartitions(*order)
    return full.mapInArrow(
        partial(_formatted, begins=begins, ends=ends),
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, new_role string, action string, inserted int, rendered string",
    )
