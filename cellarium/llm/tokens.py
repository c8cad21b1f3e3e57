"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is: u64 length, u32 masked checksum of those 8 bytes, the ids (u16 for vocabularies of up
to 65,536 ids, else u32), u32 masked checksum of the ids; all little-endian. The checksum is CRC-32 (of zlib), masked by
rotating it right by 15 bits and adding 0xA282EAD8. A shard ``part-<p>-<s>.rec`` holds records in
ascending doc_id order, and shard order is doc_id order. ``part-<p>-<s>.idx`` has an entry of
(doc_id i64, offset u64, number of ids u64) for each record, so that single records can be read
in any order without scanning.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, texts, tune

END = 1
SHARD_BYTES = 64 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
NULL_ID = -(1 << 63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ids: bytes) -> bytes:
    head = struct.pack("<Q", len(ids))
    return head + struct.pack("<I", masked(head)) + ids + struct.pack("<I", masked(ids))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The ids of the record at ``at``, and where the next begins; ValueError if it is damaged."""
    if len(data) < at + 12:
        raise ValueError("record cut short")
    head = data[at : at + 8]
    size = struct.unpack("<Q", head)[0]
    if struct.unpack_from("<I", data, at + 8)[0] != masked(head) or len(data) < at + 16 + size:
        raise ValueError("damaged record length")
    ids = data[at + 12 : at + 12 + size]
    if struct.unpack_from("<I", data, at + 12 + size)[0] != masked(ids):
        raise ValueError("damaged record")
    return ids, at + 16 + size


#: Latin capitals whose lower case is no letter below U+0250.
_FAR = "".join(c for c in map(chr, range(0xC0, 0x250)) if max(c.lower()) >= "\u0250")
#: All but lines of printable ASCII without digits and apostrophes, and of Latin letters: the pieces of
#: such are runs of letters and runs of anything else, and each has one lower case in every library.
_ODD = re.compile(f"['0-9\x00-\x1f\x7f-\xbf\xd7\xf7{_FAR}\u0250-\U0010ffff]")
#: The normalizer and splitter that the pieces below stand for (fixed values of the tokenizer's format).
_KNOWN = {
    "truncation": None, "padding": None, "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_PIECE = re.compile("[a-z\xc0-\u024f]+|[^ a-z\xc0-\u024f]+")


class Encoder(dict):
    """Piece of text to its ids as little-endian bytes.

    A tokenizer file with any other normalizer or splitter than _KNOWN is asked for whole texts.
    The known one drops white space and merges inside pieces only (runs of letters, runs of other
    characters), so a piece is encoded once and then looked up. Lines with anything but Latin
    letters and plain punctuation are taken word by word, each as the library splits it.
    """

    LIMIT = 350_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self.kind = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self._tokenizer.to_str())
        self._known = all(spec.get(k) == v for k, v in _KNOWN.items()) and self._model.__class__.__name__ == "BPE"
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}

    def __missing__(self, piece: str) -> bytes:
        ids = np.array([t.id for t in self._model.tokenize(piece.translate(self._bytes))], self.kind).tobytes()
        self[piece] = ids
        return ids

    def _words(self, line: str) -> bytes:
        words = line.split(" ")
        fresh = [w for w in set(words) if w not in self]
        for w, e in zip(fresh, self._tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self[w] = np.array(e.ids, self.kind).tobytes()
        return b"".join([self[w] for w in words])

    def encode(self, batch: list[str]) -> list[bytes]:
        if not self._known:  # another normalizer or splitter: the library's own way
            return [np.array(e.ids, self.kind).tobytes() for e in self._tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        out = []
        for text in batch:
            if len(self) > self.LIMIT:
                self.clear()
            parts = []
            for line in text.split("\n"):
                if _ODD.search(line) or any(s in line for s in self._special):
                    parts.append(self._words(line))
                else:
                    parts += map(self.__getitem__, _PIECE.findall(line.lower()))
            out.append(b"".join(parts))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process, so that tasks find what others have learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that executors can reach without Spark: file, hdfs, s3, gs and so on."""
    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], out: str, vocabulary: str, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    words = encoder(vocabulary)
    width, end = words.kind.itemsize, np.array([END], words.kind).tobytes()
    store, root = _open(out)
    part = TaskContext.get().partitionId()
    shard, body, index, size, total = 0, [], [], 0, 0
    done: list[tuple[int, int, int, int]] = []

    def put(name: str, data: list[bytes]) -> None:
        # A repeated or speculative attempt writes the same bytes; the rename makes them whole.
        hidden = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            for x in data:
                f.write(x)
        store.move(hidden, f"{root}/{name}")

    def close() -> None:
        nonlocal shard, body, index, size, total
        if index:
            name = f"part-{part:06d}-{shard:06d}"
            put(f"{name}.rec", body)
            put(f"{name}.idx", [np.array(index, INDEX).tobytes()])
            done.append((part, shard, len(index), total))
        shard, body, index, size, total = shard + 1, [], [], 0, 0

    for batch in batches:
        ids = words.encode(batch.column("text").to_pylist())
        for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids):
            x += end
            framed = frame(x)
            index.append((NULL_ID if doc_id is None else doc_id, size, len(x) // width))
            body.append(framed)
            size += len(framed)
            total += len(x) // width
            if size >= shard_bytes:
                close()
    close()
    cols = list(zip(*done)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "shard", "records", "ids"])


def write_records(docs: DataFrame, out: str, vocabulary: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append id 1, write shards and their indexes under ``out``.

    Returns the shards: (part, shard, records, ids, start), ``start`` being the ids of all shards
    before. Rows of one doc_id stand in the order of their texts' hashes; null doc_ids come first. Null
    and empty texts are the end id alone. No rows: no shards.
    """
    spark = docs.sparkSession
    n = tune(spark)
    store, root = _open(out)
    store.create_dir(root, recursive=True)
    # range borders are sampled from the keys, so the text itself is not among them
    ordered = texts(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    written = ordered.select("doc_id", "text").mapInArrow(
        partial(_write, out=out, vocabulary=vocabulary, shard_bytes=shard_bytes),
        "part long, shard long, records long, ids long",
    )
    rows, start, shards = sorted(tuple(r) for r in written.collect()), 0, []  # a row for each 64 MB
    for r in rows:
        shards.append((*r, start))
        start += r[3]
    return spark.createDataFrame(shards, "part long, shard long, records long, ids long, start long")


def _read(batches: Iterator[pa.RecordBatch], out: str, width: int) -> Iterator[pa.RecordBatch]:
    store, root = _open(out)
    for batch in batches:
        for part, shard, start in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "start"))):
            name = f"{root}/part-{part:06d}-{shard:06d}"
            with store.open_input_stream(f"{name}.idx") as f:
                index = np.frombuffer(f.read(), INDEX)
            starts, crcs = [], []
            at = 0
            with store.open_input_stream(f"{name}.rec") as f:
                for doc_id, offset, n in index.tolist():
                    if offset != at:
                        raise ValueError(f"{name}: the index says {offset}, the file {at}")
                    ids, size = unframe(f.read(16 + width * n))
                    at += size
                    starts.append(start)
                    crcs.append(zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
                    start += n
            for s in range(0, len(index), 50_000):
                cut = slice(s, s + 50_000)
                ids = index["doc_id"][cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(starts[cut], pa.int64()),
                     pa.array(index["n"][cut].astype(np.int64)), pa.array(crcs[cut], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_records(spark: SparkSession, out: str, shards: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; every checksum is verified."""
    n = max(1, shards.count())
    rows = shards.select("part", "shard", "start")
    return rows.repartition(min(n, 4 * tune(spark))).mapInArrow(
        partial(_read, out=out, width=width), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_at(out: str, part: int, shard: int, which: list[int], width: int) -> list[list[int]]:
    """The ids of the records of a shard in any order, by its index."""
    store, root = _open(out)
    name = f"{root}/part-{part:06d}-{shard:06d}"
    with store.open_input_stream(f"{name}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with store.open_input_file(f"{name}.rec") as f:
        return [np.frombuffer(unframe(f.read_at(16 + width * int(index[i]["n"]), int(index[i]["offset"])))[0], f"<u{width}").tolist() for i in which]


def token_records(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all of ``docs`` to the shared folder and read the files back."""
    spark = docs.sparkSession
    out = scratch(spark, "records")
    return read_records(spark, out, write_records(docs, out, vocabulary), encoder(vocabulary).kind.itemsize)
