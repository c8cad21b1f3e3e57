"""Substring deduplication by content-defined chunks.

A gear hash over the last 32 bytes is taken at each place; a chunk ends where it is least among
the 32 places to both sides, so chunk borders depend on the 96 bytes around them alone and an
insertion moves the borders next to it only. Chunks have 33 to 256 bytes, about 65 on average,
so that a passage of 50 words holds whole ones. Equal chunks
are found by a 128-bit digest; the first by (doc_id, place) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: A chunk of more than MOST bytes without a border of its own is cut every MOST bytes from its start; in such
#: stretches (runs of one character and the like) an insertion moves the cuts up to the next border.
RADIUS, MOST, WINDOW = 32, 256, 32
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def _ends(raw: bytes) -> list[int]:
    """Ends of the chunks of a text: behind each least hash within RADIUS bytes to both sides."""
    n = len(raw)
    if n <= RADIUS:
        return [n] if n else []
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    width = 1
    while width < WINDOW:  # h[i] = sum of gear[raw[i - j]] << j over the last 2 * width bytes
        nxt = h.copy()
        nxt[width:] += h[:-width] << np.uint32(width)
        h, width = nxt, width * 2
    wall = np.full(RADIUS, 0xFFFFFFFF, np.uint32)
    least, width = np.concatenate([wall, h, wall]), 1
    while width < RADIUS:  # least[i] over RADIUS places from i
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    marks = np.flatnonzero((h < least[:n]) & (h <= least[RADIUS + 1 : RADIUS + 1 + n])[:n]) + 1
    ends, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m > at:
            at = m
            ends.append(at)
    return ends


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, place, digest) for the first of each chunk in each text, and the digests of all."""
    for batch in batches:
        own, places, hi, lo = [], [], [], []
        for i, raw in enumerate(batch.column("raw").to_pylist()):
            at = 0
            seen = set()
            for place, end in enumerate(_ends(raw)):
                d = xxhash.xxh3_128_intdigest(raw[at:end])
                at = end
                if d not in seen:
                    seen.add(d)
                    own.append(i)
                    places.append(place)
                    hi.append(d >> 64)
                    lo.append(d & (1 << 64) - 1)
        take = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("hash").take(take), pa.array(places, pa.int32()),
             pa.array(np.array(hi, np.uint64).view(np.int64)), pa.array(np.array(lo, np.uint64).view(np.int64))],
            ["doc_id", "hash", "place", "hi", "lo"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[] for _ in range(7)]
        for raw, lost in zip(batch.column("raw").to_pylist(), batch.column("lost").to_pylist()):
            # a chunk seen before in this text goes too; ``lost`` names those first held by another
            gone, seen, at, kept, removed, spans, last = set(lost or ()), set(), 0, [], 0, 0, False
            ends = _ends(raw)
            n_lost = 0
            for place, end in enumerate(ends):
                chunk = raw[at:end]
                drop = place in gone or chunk in seen
                seen.add(chunk)
                if drop:
                    removed += len(chunk)
                    n_lost += 1
                    spans += not last
                else:
                    kept.append(chunk)
                last, at = drop, end
            left = b"".join(kept)
            for col, v in zip(out, (len(raw), len(ends), n_lost, removed, spans, left, hashlib.sha256(left).hexdigest())):
                col.append(v)
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *(pa.array(c, k) for c, k in zip(out, kinds))],
            ["row", "n_bytes", "n_chunks", "n_lost", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """Keep the first of equal chunks over all texts and drop the others.

    (row, n_bytes, n_chunks, n_lost, n_removed, n_spans, kept, kept_sha256), ``row`` with all input
    columns. The first is that of the least doc_id (null before all), then of the least text hash,
    then of the least place. Rows equal in doc_id and text are one text: each loses what the first
    of them loses. Null and empty texts have no chunks. No rows: no rows.
    """
    tune(docs.sparkSession)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", raw).alias("hash"), raw.alias("raw"), F.struct("*").alias("row"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = keyed.select("doc_id", "hash", "raw").mapInArrow(
        _digests, f"doc_id {kind}, hash long, place int, hi long, lo long"
    )
    holder = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash")
    first = (
        chunks.groupBy("hi", "lo").agg(F.min(holder).alias("first"), F.max(holder).alias("last"))
        .filter("first <> last").select("hi", "lo", "first")
    )
    lost = (
        chunks.join(first, ["hi", "lo"]).filter(holder != F.col("first"))
        .groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(F.collect_set("place").alias("lost"))
    )
    joined = keyed.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    joined = joined.select("row", "raw", "lost")
    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _cut,
        f"row {row}, n_bytes long, n_chunks long, n_lost long, n_removed long, n_spans long, kept binary, kept_sha256 string",
    )
