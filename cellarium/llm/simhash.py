"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints of 64 bits come from XXH64 of 4-word shingles. Equal fingerprints are one
node, so groups of copies of any size cost one row. Correlated bits are grouped into
partitions, each with its own threshold; the thresholds are allocated by dynamic
programming over candidate counts estimated on a bounded sample. If the thresholds t_i
satisfy sum(t_i + 1) = k + 1, two fingerprints within k bits agree within t_i bits on some
partition i, so probing partition i at distance t_i loses no link, whatever the sample says:
the sample decides the cost only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts, tune
from .components import components

BITS = 64
MAX_BITS = 4
SEED = 42
WORDS = 4
#: Fingerprints drawn to estimate candidate counts; a bound of the plan, never of the result.
SAMPLE = 20_000
#: A partition value with more members than this, and than four times what even values
#: would have, is dealt out as pairs of chunks.
HOT = 512


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of each 4-word shingle, repeats included; fewer words: the whole sequence."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    x = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return [x(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    return [x(joined[s:e], SEED) for s, e in zip(start[: 1 - WORDS].tolist(), end[WORDS - 1 :].tolist())]


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half the hashes; no words: zero."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    rows = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(rows), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("text").cast(pa.large_binary()).to_pylist()
        fps = np.fromiter(map(fingerprint, raw), np.uint64, len(raw)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per input row; null and blank texts have fingerprint zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Split the bits into m groups of like size; bits that go together stand together."""
    table = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    table -= table.mean(0)
    spread = np.sqrt((table**2).mean(0)) + 1e-9
    close = np.abs(table.T @ table) / len(table) / np.outer(spread, spread)
    left, out = set(range(BITS)), []
    for i in range(m):
        size = (len(left) + m - i - 1) // (m - i)
        own = [max(left, key=lambda b: (sum(close[b, o] for o in left), -b))]
        left.remove(own[0])
        while len(own) < size:
            nxt = max(left, key=lambda b: (close[b, own].sum(), -b))
            own.append(nxt)
            left.remove(nxt)
        out.append(sorted(own))
    return out


def plan(sample: np.ndarray, n: int, k: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost for a self-join of ``n`` fingerprints.

    cost(i, t) = probes emitted + candidates verified (a hundredth of a probe each).
    best[s] is the least cost of the partitions so far that have used up s of the k + 1
    units; a partition with threshold t uses t + 1 and one with t = -1 is not probed.
    """
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    rng = np.random.default_rng(0)
    pairs = sample[rng.integers(0, len(sample), 200_000)] ^ sample[rng.integers(0, len(sample), 200_000)]
    pairs = pairs[pairs != 0] if (pairs != 0).any() else pairs
    chosen, least = [], float("inf")
    for m in range(2, k + 2):
        groups = _groups(sample, m)
        best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            off = np.bitwise_count(pairs & _mask(bits))
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in best.items():
                for t in range(-1, k + 1 - used):
                    near = max(float((off <= t).mean()), sum(comb(len(bits), j) for j in range(t + 1)) / 2 ** len(bits))
                    own = 0 if t < 0 else sum(comb(len(bits), j) for j in range(t + 1)) + 0.01 * n * near
                    if cost + own < nxt.get(used + t + 1, (float("inf"),))[0]:
                        nxt[used + t + 1] = (cost + own, [*ts, t])
            best = nxt
        if best[k + 1][0] < least:
            least, chosen = best[k + 1][0], [(b, t) for b, t in zip(groups, best[k + 1][1]) if t >= 0]
    return chosen


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _signatures(batches: Iterator[pa.RecordBatch], parts: list[tuple[list[int], int]]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, fp, probe): the own value of each partition, and the values around it."""
    flips = [
        (_mask(bits), [np.uint64(sum(1 << b for b in c)) for j in range(1, t + 1) for c in combinations(bits, j)])
        for bits, t in parts
    ]
    for batch in batches:
        fps = np.asarray(batch.column("fp")).view(np.uint64)
        for i, (mask, around) in enumerate(flips):
            own = fps & mask
            for probe, flip in enumerate([np.uint64(0), *around]):
                n = len(fps)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, i, np.int32)),
                        pa.array((own ^ flip).view(np.int64)),
                        pa.array(fps.view(np.int64)),
                        pa.array(np.full(n, probe > 0)),
                    ],
                    ["part", "key", "fp", "probe"],
                )


def _tree(fps: np.ndarray, k: int, out: list[tuple[int, int]]) -> None:
    """Links that connect what is connected among ``fps``: each found node is compared with
    the nodes not found yet, so a dense group costs little more than its size."""
    rest = np.unique(fps)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            a = todo.pop()
            near = np.bitwise_count(rest ^ a) <= k
            if near.any():
                found = rest[near]
                out.extend((int(a), int(b)) for b in found)
                todo.extend(found)
                rest = rest[~near]


def _verify(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, cell, probe) to links within k bits, a forest for each group."""
    names = ("part", "key", "cell", "fp", "probe")
    held: list[np.ndarray] | None = None

    def done(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray] | None, list[tuple[int, int]]]:
        part, key, cell, fp, probe = cols
        new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        ends = np.r_[new[1:], len(part)]
        keep = None
        if not last:
            keep = [c[new[-1] :] for c in cols]
            new, ends = new[:-1], ends[:-1]
        links: list[tuple[int, int]] = []
        size = ends - new
        for s in np.flatnonzero(size > 64):
            if not probe[new[s] : ends[s]].all():
                _tree(fp[new[s] : ends[s]], k, links)
        small = np.flatnonzero((size > 1) & (size <= 64))
        own = np.repeat(ends[small], size[small])
        rows = np.concatenate([np.arange(a, b) for a, b in zip(new[small], ends[small])]) if len(small) else new[:0]
        index = ~probe[rows]
        rows, own = rows[index], own[index]
        for step in range(1, 64):
            inside = rows + step < own
            rows, own = rows[inside], own[inside]
            if not len(rows):
                break
            a, b = fp[rows], fp[rows + step]
            near = (np.bitwise_count(a ^ b) <= k) & (a != b)
            links.extend(zip(a[near].tolist(), b[near].tolist()))
        return keep, links

    def rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(links, np.uint64).reshape(-1, 2)
        both = np.unique(np.sort(both, axis=1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        cols = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in names]
        cols[3] = cols[3].view(np.uint64)
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if len(held[0]):
            held, links = done(held, False)
            if links:
                yield rows(links)
    if held is not None and len(held[0]):
        links = done(held, True)[1]
        if links:
            yield rows(links)


def links(nodes: DataFrame, k: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes(fp)`` that connect every pair within k bits.

    Not all pairs are emitted, but enough of them that the components are those of all pairs.
    """
    spark = nodes.sparkSession
    n = tune(spark)
    drawn = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    count = nodes.count()
    parts = plan(np.array([r[0] for r in drawn], np.int64).view(np.uint64), count, k)
    most = max([HOT, *(4 * count // 2 ** len(bits) for bits, _ in parts)])
    marks = nodes.select("fp").mapInArrow(
        partial(_signatures, parts=parts), "part int, key long, fp long, probe boolean"
    )
    hot = cut(
        nodes.select("fp")
        .mapInArrow(partial(_signatures, parts=[(b, 0) for b, _ in parts]), "part int, key long, fp long, probe boolean")
        .groupBy("part", "key").count().filter(F.col("count") > most)
        .select("part", "key", F.ceil(F.col("count") / most).cast("int").alias("chunks")),
        "hot",
    )
    if hot.isEmpty():
        cells = marks.withColumn("cell", F.lit(0))
    else:
        # pairs of chunks: a member of chunk c stands in cells (c, j) and (j, c), so any two meet once
        c = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        cells = (
            marks.join(hot, ["part", "key"], "left")
            .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("cell", (F.least(c, "j") * F.col("chunks") + F.greatest(c, "j")).cast("int"))
        )
    return (
        cells.select("part", "key", "cell", "fp", "probe")
        .repartition(n, "part", "key", "cell")
        .sortWithinPartitions("part", "key", "cell", "probe")
        .mapInArrow(partial(_verify, k=k), "a long, b long")
    )


def near_duplicates(docs: DataFrame, k: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links of ``k`` or fewer differing bits,
    the own one included. Null or blank texts share fingerprint zero and are linked like any
    other. Rows with one doc_id twice give two rows. A null doc_id never names a component
    unless all its members are null. Extra columns are ignored. No rows: no rows.
    """
    marked = cut(fingerprints(docs), "fp")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", marked.count())
    joined = components(links(nodes, k), nodes.count())
    roots = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = roots.join(
        roots.groupBy("root").agg(F.min("least").alias("component_id")), "root"
    ).select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
