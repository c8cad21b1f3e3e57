"""Benchmark decontamination: which short items do long documents contain?

Items are put into size classes by their number of distinct 5-word shingles. Each item's sketch is
its MinHash bottom values, as many as its class needs: of n shingles, a document that holds a share
t or more misses at most floor((1 - t) n), so of the floor((1 - t) u) + 1 least-hashed ones (u the
upper size of the class) at least one must be in the document. Documents are of any length: their
shingle hashes probe the sketches, and what is found is verified on the shingles themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, tune

WORDS = 5
SHARE = 0.8
#: Bytes of item text that are held by each task at once; more items take more passes.
BLOCK_BYTES = 16 << 20
#: ASCII that is neither letter nor digit parts words.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def _run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` words, given those of the words."""
    n = len(h) - length + 1
    if n < 1 or not length:
        return np.empty(0, np.uint64)
    out = np.full(n, length, np.uint64)
    for j in range(length):
        out = out * _MUL + h[j : j + n]
    out ^= out >> np.uint64(31)
    return out * _MUL


def _word_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.array([known[w] for w in words], np.uint64)


def _shingle_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    """One hash for each run of five words; fewer words: one for the whole sequence; none: none."""
    return _run_hashes(_word_hashes(words, known), min(WORDS, len(words)))


def _shingle(words: list[bytes], i: int) -> bytes:
    return b" ".join(words[i : i + WORDS])


class Sketches:
    """Items with their shingles, and the sketch values that find them."""

    def __init__(self, items: list[tuple[object, str]], share: float):
        known = _Hashes()
        self.items: list[tuple[object, set[bytes], np.ndarray]] = []
        self.by: dict[int, list[int]] = defaultdict(list)
        self.short: set[int] = set()
        for item_id, text in items:
            words = words_of(text)
            h = _shingle_hashes(words, known)
            if not len(h):
                continue
            shingles = {_shingle(words, i) for i in range(len(h))}
            values = np.unique(h)
            upper = 1 << (len(values) - 1).bit_length()  # the class holds sizes above upper / 2, to upper
            own = len(self.items)
            for v in values[: int((1 - share) * upper + 1e-9) + 1].tolist():
                self.by[v].append(own)
            if len(words) < WORDS:
                self.short.add(len(words))
            self.items.append((item_id, shingles, values))
        self.keys = np.array(sorted(self.by), np.uint64)
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.share = share

    def find(self, text: str, known: _Hashes) -> list[tuple[object, int, int]]:
        """(item_id, its shingles, how many of them the text holds) for each item that it contains."""
        words = words_of(text)
        own = _word_hashes(words, known)
        h = _run_hashes(own, WORDS)
        hits: dict[int, None] = {}
        for runs in (h, *(_run_hashes(own, n) for n in self.short)):  # items of under five words: runs of that many words
            maybe = np.unique(runs[self.marks[(runs & np.uint64((1 << 22) - 1)).astype(np.int64)]])
            for v in maybe.tolist():
                hits.update(dict.fromkeys(self.by.get(v, ())))
        out = []
        for k in sorted(hits):
            item_id, shingles, values = self.items[k]
            if len(shingles) == 1 and len(next(iter(shingles)).split()) < WORDS:
                n = len(next(iter(shingles)).split())
                shared = int(any(b" ".join(words[i : i + n]) in shingles for i in range(len(words) - n + 1)))
            else:
                at = np.flatnonzero(np.isin(h, values))
                shared = len({_shingle(words, i) for i in at.tolist()} & shingles)
            if shared >= self.share * len(shingles) - 1e-9:
                out.append((item_id, len(shingles), shared))
        return out


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in items.select("item_id", "text").filter("text is not null").distinct().toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE, limit: int = BLOCK_BYTES) -> DataFrame:
    """(row, hits): each row of ``docs`` with the items whose shingles it holds to ``share`` or more.

    ``hits`` is array<struct<item_id, n_shingles, n_shared>>. The items are taken in blocks of
    ``limit`` bytes of text, one pass over the documents each. Words are of lower case, parted by
    ASCII characters that are neither letters nor digits; an item of under five words is contained
    where its words stand in a row. Items without a word, null texts and empty texts contain and
    are contained in nothing. Repeated items count once, repeated documents each. No rows: no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = items.schema["item_id"].dataType
    hit = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]))
    now = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.array().cast(hit).alias("hits"))
    schema = T.StructType([now.schema["row"], T.StructField("text", T.StringType()), T.StructField("hits", hit)])
    for number, block in enumerate(_blocks(items, limit)):
        if number:
            now = cut(now, "hits")
        held = spark.sparkContext.broadcast(Sketches(block, share))

        def probe(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, own = _Hashes(), held.value
            for batch in batches:
                hits = [
                    (old or []) + [{"item_id": i, "n_shingles": n, "n_shared": s} for i, n, s in own.find(text, known)]
                    for text, old in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("text"), pa.array(hits, batch.schema.field("hits").type)], ["row", "text", "hits"]
                )

        now = now.mapInArrow(probe, schema)
    return now.select("row", "hits")


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment), a row for each contained item."""
    found = contained(docs.select("doc_id", "text"), items)
    return found.select("row.doc_id", F.explode("hits").alias("h")).select(
        "doc_id", "h.item_id", "h.n_shingles", "h.n_shared", (F.col("h.n_shared") / F.col("h.n_shingles")).alias("containment")
    )
