"""Repeated substrings by a common-prefix-aware distributed merge sort of sampled suffixes.

Every 200-byte window holds a minimizer: of its 64-byte strings the one of least hash, the
leftmost on ties. Equal windows have their minimizer at the same offset, so only suffixes
that start at minimizers ("anchors", about 1.5 % of the positions) are sorted, each with what
stands to its left. An anchor's bytes are covered by a repeated window exactly when another
anchor of the same 64 bytes shares r bytes to the right and l to the left with l + r >= 200.

1. Fingerprint rounds (prefix doubling): anchors whose 64 bytes occur once go no further.
2. Each task sorts the suffixes of its anchors, front-codes the run (common prefix length and
   the rest) and sends one run to each partition. Equal contexts of a run are one entry.
3. A loser tree merges the runs. Its nodes keep the common prefix with the last winner, so
   bytes known to be equal are never compared again. Groups of 64 equal bytes fall out of the
   merge; in each the shared lengths to both sides give the covered interval.
4. Anchors of very common 64 bytes (more than HOT owners) could fill one partition with one
   group. Their windows are instead dealt out by 128-bit fingerprint, one entry a task and window:
   of n different windows two are taken for equal with a chance of n^2 / 2^129.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, tune

LENGTH = 200
K = 64
REACH = LENGTH - K  # bytes to the left of an anchor that a window can hold
HOT = 512
#: Bytes of text hashed at once; longer texts are taken in overlapping pieces.
BLOCK = 1 << 22
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = _RNG.integers(0, 1 << 62, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _anchors(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``buf`` (pieces laid end to end, one beginning at each of ``starts``) of the
    minimizers of all windows inside a piece, and the hashes of their 64 bytes."""
    n = len(buf)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _BYTE[buf]
    for i in range(6):  # strings of 1, 2, 4, ... 64 bytes
        half = 1 << i
        h = h[:-half] * _STEP[i] + h[half:]
    h = _mix(h)
    low = np.uint64((1 << 24) - 1)  # a block holds less than 2 * BLOCK + LENGTH bytes
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = LENGTH - K + 1
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - LENGTH + 1], least[span - width :])
    inside = np.ones(n - LENGTH + 1, bool)
    for s in starts[1:]:
        inside[max(0, s - LENGTH + 1) : s] = False
    least = least[inside]
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.unique(least[np.r_[True, least[1:] != least[:-1]]] & low).astype(np.int64)
    return at, h[at]


def text_anchors(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index into raws, position, hash) of the anchors of all texts, a block at a time."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.array([len(p[2]) for p in pieces], np.int64)
        starts = np.cumsum(lens) - lens
        at, h = _anchors(np.frombuffer(b"".join(p[2] for p in pieces), np.uint8), starts)
        own = np.searchsorted(starts, at, "right") - 1
        doc = np.array([p[0] for p in pieces], np.int64)
        base = np.array([p[1] for p in pieces], np.int64)
        return doc[own], at - starts[own] + base[own], h

    for i, raw in enumerate(raws):
        for s in range(0, max(1, len(raw) - LENGTH + 1), BLOCK):
            piece = raw[s : s + BLOCK + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            pieces.append((i, s, piece))
            size += len(piece)
            if size >= BLOCK:
                yield block()
                pieces, size = [], 0
    if pieces:
        yield block()


def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cQ", a.dtype.char.encode(), a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = raw[0], 1, []
    heads = []
    for _ in range(n):
        heads.append(struct.unpack_from("<cQ", raw, at))
        at += 9
    for kind, size in heads:
        out.append(np.frombuffer(raw, np.dtype(kind.decode()), size // np.dtype(kind.decode()).itemsize, at))
        at += size
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted ``x``."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _runs_of_pairs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted ``x`` of two columns."""
    return np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)]) if len(x) else np.empty(0, np.int64)


def _rows(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols.values()], list(cols))


# -- round 1: which 64-byte strings occur more than once ------------------------------------


def _offer(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """For each partition one payload of (string hash, owner, position), in the order of the texts,
    in which owners and positions take little room. An owner is its text's hash alone: should two
    be alike, anchors are looked at in vain, none is lost."""
    held: list[tuple[np.ndarray, ...]] = []
    docs: list[int] = []
    size = 0

    def flush() -> pa.RecordBatch:
        own, at, h = (np.concatenate(x) for x in zip(*held))
        part = (h % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, at, h, part = own[order], at[order], h[order], part[order]
        table = np.array(docs, np.int64)
        cuts = np.r_[_runs(part), len(part)]
        parts, blobs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            used, index = np.unique(own[a:b], return_inverse=True)
            parts.append(int(part[a]))
            blobs.append(_pack(h[a:b], index.astype(np.uint32), at[a:b].astype(np.uint32), table[used]))
        return _rows(part=(parts, pa.int32()), payload=(blobs, pa.binary()))

    for batch in batches:
        raws = batch.column("raw").to_pylist()
        base = len(docs)
        docs.extend(batch.column("hash").to_pylist())
        for own, at, h in text_anchors(raws):
            held.append((own + base, at, h))
            size += len(own)
        if size > 3_000_000:
            yield flush()
            held, docs, size = [], [], 0
    if size:
        yield flush()


def _repeated(batches: Iterator[pa.RecordBatch], most: int = HOT) -> Iterator[pa.RecordBatch]:
    """Anchors whose 64 bytes occur again: (hash of the text, position, hot)."""
    hs, ats, ids = [], [], []
    for batch in batches:
        for blob in batch.column("payload").to_pylist():
            h, own, at, table = _unpack(blob)
            hs.append(h)
            ids.append(table[own])
            ats.append(at)
    if not hs:
        return
    h, ident, at = (np.concatenate(x) for x in (hs, ids, ats))
    order = np.argsort(h, kind="stable")
    begin = _runs(h[order])
    times = np.diff(np.r_[begin, len(h)])
    many = np.repeat(times, times)
    keep = order[many > 1]
    hot = (many > most)[many > 1]
    for s in range(0, len(keep), 200_000):
        k = keep[s : s + 200_000]
        yield _rows(
            hash=(ident[k], pa.int64()), at=(at[k].astype(np.int64), pa.int64()),
            hot=(hot[s : s + 200_000], pa.bool_()),
        )


# -- round 2: front-coded runs, merged by a loser tree ---------------------------------------


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    while known + 32 <= n and a[known : known + 32] == b[known : known + 32]:
        known += 32
    while known < n and a[known] == b[known]:
        known += 1
    return known


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted keys as (common prefix with the one before, length of the rest), and the rests."""
    lcps, rests, last = [], [], b""
    for key in keys:
        n = _shared(last, key, 0)
        lcps.append(n)
        rests.append(key[n:])
        last = key
    return np.array(lcps, np.uint16), np.array([len(r) for r in rests], np.uint16), b"".join(rests)


class Run:
    """A front-coded run, decoded a key at a time; ``lcp`` is the common prefix with the key before."""

    def __init__(self, lcps: np.ndarray, lens: np.ndarray, rests: bytes):
        self._lcps, self._lens, self._rests = lcps.tolist(), lens.tolist(), rests
        self._at, self.index, self.key, self.lcp = 0, -1, b"", 0
        self.step()

    def step(self) -> None:
        self.index += 1
        if self.index >= len(self._lcps):
            self.key = None
            return
        self.lcp, n = self._lcps[self.index], self._lens[self.index]
        self.key = self.key[: self.lcp] + self._rests[self._at : self._at + n]
        self._at += n


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, int, int]]:
    """(common prefix with the key before, key, run, index in it) over all runs in order.

    Every inner node holds the loser of its match and the prefix that it shares with the winner.
    Of two keys that share unlike lengths with the last winner the longer one wins unseen; of
    like lengths, comparison begins behind them.
    """
    size = 1
    while size < len(runs):
        size *= 2
    lcp = [0] * size  # with the last winner on the path
    tree = [0] * size

    def loses(a: int, b: int) -> bool:
        """Whether a's key comes after b's; the loser's prefix becomes that with the winner."""
        x = runs[a].key if a < len(runs) else None
        if x is None:
            return True
        y = runs[b].key if b < len(runs) else None
        if y is None:
            return False
        if lcp[a] != lcp[b]:
            return lcp[a] < lcp[b]
        n = _shared(x, y, lcp[a])
        after = x[n:] > y[n:] or (len(x) == n == len(y) and a > b)
        lcp[a if after else b] = n
        return after

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        a, b = (b, a) if loses(a, b) else (a, b)
        tree[node] = b
        return a

    best = build(1) if size > 1 else 0
    while best < len(runs) and runs[best].key is not None:
        run = runs[best]
        yield lcp[best], run.key, best, run.index
        run.step()
        lcp[best] = run.lcp
        node = (best + size) // 2
        while node:
            if loses(best, tree[node]):
                best, tree[node] = tree[node], best
            node //= 2


_TWO = "part int, kind int, payload binary"


def _send(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Runs of the rarer anchors (kind 0), window fingerprints of the others (1), what is known here (2)."""
    entries: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    common: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    docs: list[tuple[int, int]] = []

    def owners(lists: list[list[tuple[int, int]]]) -> list[np.ndarray]:
        flat = np.array([o for own in lists for o in own], np.int64).reshape(-1, 2)
        used, index = np.unique(flat[:, 0], return_inverse=True)
        table = np.array(docs, np.int64).reshape(-1, 2)[used].ravel()
        return [np.array([len(x) for x in lists], np.uint32), index.astype(np.uint32), flat[:, 1].astype(np.uint32), table]

    def flush() -> pa.RecordBatch:
        parts, kinds, blobs = [], [], []
        by: dict[int, list[tuple[bytes, int]]] = {}
        for e in entries:
            by.setdefault(xxhash.xxh3_64_intdigest(e[0][:K]) % n, []).append(e)
        for part, own in by.items():
            own.sort()
            lcps, lens, rests = front_code([k for k, _ in own])
            right = np.array([r for _, r in own], np.uint16)
            parts.append(part)
            kinds.append(0)
            blobs.append(_pack(lcps, lens, np.frombuffer(rests, np.uint8), right, *owners([entries[e] for e in own])))
        if common:
            hashes, who, known = [], [], []
            for (key, right), own in common.items():
                whole = key[right:][::-1] + key[:right]
                left = len(key) - right
                if len(whole) < LENGTH:
                    continue
                if len(own) > 1:
                    known.extend((i, at - left, at + right) for i, at in own)
                i, at = own[0] if len(own) == 1 else (-1, 0)
                digest = xxhash.xxh3_128_digest
                for s in range(len(whole) - LENGTH + 1):
                    hashes.append(digest(whole[s : s + LENGTH]))
                    who.append((i, at - left + s if i >= 0 else 0))
            h = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
            w = np.array(who, np.int64).reshape(-1, 2)
            order = np.lexsort((h[:, 1], h[:, 0]))
            h, w = h[order], w[order]
            begin = _runs_of_pairs(h)
            times = np.diff(np.r_[begin, len(h)])
            # Windows that occur twice here by different starts are known to repeat; one window
            # reached from two anchors of its own text is not.
            first = np.repeat(begin, times)
            same = (w == w[first]).all(1) & (w[:, 0] >= 0)
            alike = np.logical_and.reduceat(same, begin) if len(begin) else same
            alone = np.repeat((times == 1) | alike, times)
            dup = w[~alone & (w[:, 0] >= 0)]
            known.extend((int(i), int(s), int(s) + LENGTH) for i, s in dup)
            uh, uw = h[begin], np.where(alone[begin][:, None], w[begin], -1)
            part = (uh[:, 0] % np.uint64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.r_[_runs(part[order]), len(order)]
            table = np.array(docs, np.int64).reshape(-1, 2)
            for a, b in zip(cuts[:-1], cuts[1:]):
                o = order[a:b]
                used, index = np.unique(uw[o, 0], return_inverse=True)
                parts.append(int(part[o[0]]))
                kinds.append(1)
                blobs.append(_pack(uh[o].ravel(), used, index.astype(np.uint32), uw[o, 1].astype(np.int64), table[np.maximum(used, 0)].ravel()))
            if known:
                kn = _union(np.array(known, np.int64))
                parts.append(len(docs) % n)
                kinds.append(2)
                blobs.append(_pack(table[kn[:, 0]].ravel(), kn[:, 1], kn[:, 2]))
        return _rows(part=(parts, pa.int32()), kind=(kinds, pa.int32()), payload=(blobs, pa.binary()))

    for batch in batches:
        raws = zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "raw", "at", "hot")))
        for doc, ident, raw, ats, hots in raws:
            i = len(docs)
            docs.append((doc, ident))
            for at, hot in dict(zip(ats, hots)).items():  # pieces of a long text may name one twice
                right = raw[at : at + LENGTH]
                key = (right + raw[max(0, at - REACH) : at][::-1], len(right))
                (common if hot else entries).setdefault(key, []).append((i, at))
        if len(entries) > 150_000 or len(common) > 10_000:
            yield flush()
            entries, common, docs = {}, {}, []
    if entries or common:
        yield flush()


def _union(x: np.ndarray) -> np.ndarray:
    """Rows (owner, begin, end) with overlapping intervals of an owner made one."""
    if not len(x):
        return x.reshape(0, 3)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    far = x[:, 2] + x[:, 0] * (1 << 40)
    far = np.maximum.accumulate(far)
    new = np.r_[True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] + x[1:, 0] * (1 << 40) > far[:-1])]
    begin = np.flatnonzero(new)
    ends = far[np.r_[begin[1:] - 1, len(x) - 1]] - x[begin, 0] * (1 << 40)
    return np.stack([x[begin, 0], x[begin, 1], ends], 1)


def group_intervals(group: list[tuple[bytes, int, int]]) -> list[tuple[int, int]]:
    """For contexts (right part and reversed left part, length of the right one, owners) that begin
    with the same 64 bytes: how many bytes to the left and right repeated windows cover; (0, 0): none.
    """
    if len(group) == 1:
        key, right, times = group[0]
        return [(len(key) - right, right) if times > 1 and len(key) >= LENGTH else (0, 0)]
    rights = [k[:r] for k, r, _ in group]
    lefts = [k[r:] for k, r, _ in group]
    out = [(len(l), len(r)) if t > 1 and len(l) + len(r) >= LENGTH else (0, 0) for l, r, (_, _, t) in zip(lefts, rights, group)]
    m = len(group)
    if m <= 6:
        for i in range(m):
            for j in range(i):
                r = _shared(rights[i], rights[j], K)
                l = _shared(lefts[i], lefts[j], 0)
                if l + r >= LENGTH:
                    for x in (i, j):
                        out[x] = (max(out[x][0], l), max(out[x][1], r))
        return out

    def matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(m, width), lens

    (rm, rl), (lm, ll) = matrix(rights, LENGTH), matrix(lefts, REACH)

    def agree(mat: np.ndarray, lens: np.ndarray, i: int) -> np.ndarray:
        off = mat != mat[i]
        n = np.where(off.any(1), off.argmax(1), mat.shape[1])
        return np.minimum(n, np.minimum(lens, lens[i]))

    best = np.array(out, np.int64)
    for i in range(m):
        r, l = agree(rm, rl, i), agree(lm, ll, i)
        ok = l + r >= LENGTH
        ok[i] = False
        if ok.any():
            best[i] = np.maximum(best[i], (l[ok].max(), r[ok].max()))
    return [tuple(x) for x in best.tolist()]


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered intervals (doc, hash, begin, end) of what this partition was sent."""
    runs, facts, windows, out = [], [], [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist()):
            got = _unpack(blob)
            if kind == 0:
                lcps, lens, rests, right, times, own, at, table = got
                runs.append(Run(lcps, lens, rests.tobytes()))
                facts.append((right.tolist(), times, np.cumsum(times) - times, own, at, table.reshape(-1, 2)))
            elif kind == 1:
                windows.append(got)
            else:
                table, begin, end = got
                out.append(np.column_stack([table.reshape(-1, 2), begin, end]))
    group: list[tuple[bytes, int, int]] = []
    places: list[list[tuple[int, int]]] = []
    found: list[np.ndarray] = []

    def close() -> None:
        for (left, right), where in zip(group_intervals(group), places):
            if left + right:
                for run, index in where:
                    _, times, first, own, at, table = facts[run]
                    s = slice(int(first[index]), int(first[index]) + int(times[index]))
                    pos = at[s].astype(np.int64)
                    found.append(np.column_stack([table[own[s]], pos - left, pos + right]))

    last = None
    for lcp, key, run, index in merge(runs) if runs else ():
        right, times = facts[run][0][index], int(facts[run][1][index])
        if last is not None and lcp < K:
            if len(group) > 1 or group[0][2] > 1:
                close()
            group, places = [], []
        if group and key == last and group[-1][1] == right:
            group[-1] = (key, right, group[-1][2] + times)
            places[-1].append((run, index))
        else:
            group.append((key, right, times))
            places.append([(run, index)])
        last = key
        if len(found) > 20_000:
            out.append(np.concatenate(found))
            found.clear()
    if group:
        close()
    out.extend(found)
    if windows:
        h = np.concatenate([w[0] for w in windows]).reshape(-1, 2)
        who = np.concatenate([np.column_stack([w[4].reshape(-1, 2)[w[2]], w[3], w[1][w[2]]]) for w in windows])
        order = np.lexsort((h[:, 1], h[:, 0]))
        begin = _runs_of_pairs(h[order])
        times = np.diff(np.r_[begin, len(h)])
        # One entry a task for a window of one start; -1 marks one that its task knows to repeat.
        who = who[order]
        # The same start may come from two flushes only if two rows are the same row: then it repeats.
        many = np.repeat(times, times) > 1
        dup = who[many & (who[:, 3] >= 0)]
        out.append(np.column_stack([dup[:, 0], dup[:, 1], dup[:, 2], dup[:, 2] + LENGTH]))
    if not out:
        return
    rows = np.concatenate(out)
    keys, index = np.unique(rows[:, :2], axis=0, return_inverse=True)
    merged = _union(np.column_stack([index.ravel(), rows[:, 2], rows[:, 3]]))
    for s in range(0, len(merged), 200_000):
        m = merged[s : s + 200_000]
        yield _rows(
            doc=(keys[m[:, 0], 0], pa.int64()), hash=(keys[m[:, 0], 1], pa.int64()),
            begin=(m[:, 1], pa.int64()), end=(m[:, 2], pa.int64()),
        )


# -- the operator ----------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc, hash (together its identity), raw bytes, row."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        F.xxhash64("doc_id").alias("doc"), F.xxhash64(F.col("doc_id"), raw).alias("hash"), raw.alias("raw"),
        F.struct("*").alias("row"),
    )


def repeated_spans(docs: DataFrame, most: int = HOT) -> DataFrame:
    """(doc, hash, spans array<struct<begin, end>>): covered bytes of the rows that have any.

    Rows that repeat another row with its doc_id and text are told apart only by their number:
    each text of 200 bytes or more that occurs in two rows is covered as a whole.
    """
    spark = docs.sparkSession
    n = tune(spark)
    keyed = _keyed(docs).select("doc", "hash", "raw").filter(F.length("raw") >= LENGTH)
    offers = keyed.select("hash", "raw").mapInArrow(partial(_offer, n=n), "part int, payload binary")
    again = by_key(offers, n, "part").mapInArrow(partial(_repeated, most=most), "hash long, at long, hot boolean")
    ats = again.groupBy("hash").agg(F.collect_list(F.struct("at", "hot")).alias("ats"))
    held = keyed.join(ats, "hash").select(
        "doc", "hash", "raw", F.col("ats.at").alias("at"), F.col("ats.hot").alias("hot")
    )
    sent = held.mapInArrow(partial(_send, n=n), _TWO)
    covered = by_key(sent, n, "part").mapInArrow(_covered, "doc long, hash long, begin long, end long")
    return covered.groupBy("doc", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {"row": batch.column("row"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
        for raw, spans in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist()):
            kept, at, runs, gone = [], 0, 0, 0
            for a, b in merged_spans([(s["begin"], s["end"]) for s in spans or ()]):
                kept.append(raw[at:a])
                at, runs, gone = b, runs + 1, gone + b - a
            kept.append(raw[at:])
            left = b"".join(kept)
            for name, value in zip(list(cols)[1:], (len(raw), gone, runs, left, hashlib.sha256(left).hexdigest())):
                cols[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [cols["row"], pa.array(cols["n_bytes"], pa.int64()), pa.array(cols["n_removed"], pa.int64()),
             pa.array(cols["n_spans"], pa.int64()), pa.array(cols["kept"], pa.binary()), pa.array(cols["kept_sha256"], pa.string())],
            list(cols),
        )


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with what overlaps or touches made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, most: int = HOT) -> DataFrame:
    """Cut every byte covered by a 200-byte string that starts anywhere else, in this text or another.

    (row, n_bytes, n_removed, n_spans, kept, kept_sha256): ``row`` holds all columns of the input
    row, ``kept`` the bytes that remain. Null and empty texts have no bytes; texts under 200 bytes
    lose none; equal texts of 200 bytes or more lose all, also where whole rows are repeated. Null doc_ids are
    like any other. Columns of any name may stand in ``docs``. No rows: no rows.
    """
    spans = repeated_spans(docs, most)
    joined = _keyed(docs).select("doc", "hash", "row").join(spans, ["doc", "hash"], "left").select(
        "row", F.coalesce(F.col("row.text").cast("binary"), F.lit(b"")).alias("raw"), "spans"
    )
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _removed,
        f"row {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
    )

