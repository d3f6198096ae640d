"""Sorted-string-table shards of token ids.

One file holds entries in ascending key order:

    block*  index  bloom  footer

A block packs up to ``BLOCK`` bytes of entries. An entry is (shared, unshared, value length) as varints, the
unshared part of the key and the value; the key shares its first bytes with the key before it, except at
restart points (every 16th entry), whose offsets end the block and let a lookup search it by halving. The
index holds each block's last key, offset and length. The Bloom filter answers most lookups of absent keys
without a block read. The footer has the places of index and filter, the number of entries and of ids, and the
magic number; all checks are CRC-32.

Keys are one byte (0 for a null identifier, else 1) and the identifier as a big-endian integer with its sign
bit flipped, so byte order is the order of identifiers, nulls first. Equal identifiers are kept as entries of
their own in the order written. Values are ids as little-endian integers of 2 or 4 bytes. Empty texts hold
what is appended to every document; an empty table gives no files and no rows.
"""

from __future__ import annotations

import io
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import partitions, scratch_path
from paceline.llm.tokens import encoder

BLOCK = 64 * 1024
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = 0x5041434554424C31
FOOTER = struct.Struct("<QQQQQQBxxxIQ")


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + struct.pack(">Q", (int(identifier) + (1 << 63)) & (2**64 - 1))


def identifier_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes entries, given in ascending key order, to a binary file object."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.n = self.n_ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""

    def add(self, identifier: int | None, ids: np.ndarray) -> None:
        key, value = key_of(identifier), ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block, self.n, self.n_ids = key, self.in_block + 1, self.n + 1, self.n_ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        data += struct.pack("<I", zlib.crc32(data))
        self.out.write(data)
        place = (self.at, len(data))
        self.at += len(data)
        return place

    def _end_block(self) -> None:
        if self.in_block:
            tail = b"".join(struct.pack("<I", r) for r in self.restarts) + struct.pack("<I", len(self.restarts))
            self.index.append((self.last, *self._put(bytes(self.block) + tail)))
            self._begin()

    def close(self) -> int:
        """Ends the file; returns its size."""
        self._end_block()
        packed = b"".join(_varint(len(k)) + k + _varint(o) + _varint(s) for k, o, s in self.index)
        index = self._put(packed)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _bloom_places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        places = (*index, *self._put(bytes(bloom)))
        head = struct.pack("<QQQQQQB", *places, self.n, self.n_ids, self.width)
        self.out.write(FOOTER.pack(*places, self.n, self.n_ids, self.width, zlib.crc32(head), MAGIC))
        return self.at + FOOTER.size


class Reader:
    """Looks up and scans a shard, given as a seekable binary file object."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        file.seek(end - FOOTER.size)
        *places, self.n, self.n_ids, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC or zlib.crc32(struct.pack("<QQQQQQB", *places, self.n, self.n_ids, self.width)) != crc:
            raise ValueError("not a shard, or a damaged footer")
        packed, self.bloom = self._get(places[0], places[1]), self._get(places[2], places[3])
        self.index: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(packed):
            size, at = _read_varint(packed, at)
            key, at = packed[at : at + size], at + size
            offset, at = _read_varint(packed, at)
            length, at = _read_varint(packed, at)
            self.index.append((key, offset, length))
        self.last_keys = [k for k, _, _ in self.index]

    def _get(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("damaged block")
        return data[:-4]

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        data = self._get(*self.index[i][1:])
        (n,) = struct.unpack("<I", data[-4:])
        return data[: -4 - 4 * n], list(struct.unpack(f"<{n}I", data[-4 - 4 * n : -4]))

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._entries(self._block(i)[0], 0):
                yield identifier_of(key), ids

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier (none if it is absent)."""
        key, bits = key_of(identifier), len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits)):
            return []
        found: list[np.ndarray] = []
        for i in range(bisect_left(self.last_keys, key), len(self.index)):
            data, restarts = self._block(i)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart point whose key is below the wanted one
                middle = (low + high + 1) // 2
                low, high = (middle, high) if next(self._entries(data, restarts[middle]))[0] < key else (low, middle - 1)
            for k, ids in self._entries(data, restarts[low]):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
        return found


def open_file(uri: str, mode: str):
    """A file of the shared folder, by any scheme that Arrow's file systems know."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return where.open_input_file(path)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encodes docs and writes one shard for each range of doc_id; returns the manifest, a row for each shard.

    A retried task writes a file of its own; only files named in the manifest count.
    """
    n = partitions(docs.sparkSession)

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, out, writer = encoder("word", tokenizer), None, None
        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        first = None
        for f in frames:
            keys = [None if pd.isna(k) else int(k) for k in f["doc_id"]]
            texts = [t or "" for t in f["text"]]
            for at in range(0, len(texts), 2000):
                for key, ids in zip(keys[at : at + 2000], encode.encode(texts[at : at + 2000])):
                    if writer is None:
                        width = 2 if encode.library.get_vocab_size() <= 65536 > end_id else 4
                        out, first = open_file(uri, "w"), key
                        writer = Writer(out, width)
                    writer.add(key, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            size = writer.close()
            out.close()
            yield pd.DataFrame({"shard": [task.partitionId()], "uri": [uri], "first_id": pd.array([first], "Int64"), "n_docs": [writer.n], "n_ids": [writer.n_ids], "n_bytes": [size]})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    return ordered.mapInPandas(shard, "shard int, uri string, first_id long, n_docs long, n_ids long, n_bytes long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry of the manifest's shards, read from the files.

    The manifest has a row for each shard; its running sum, over that many rows, is made on the driver.
    """
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        shards.append((r["uri"], start))
        start += r["n_ids"]
    spark = manifest.sparkSession
    listed = spark.createDataFrame(shards, "uri string, start long").repartition(max(1, len(shards)))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri, start in zip(f["uri"], f["start"]):
                with open_file(uri, "r") as file:
                    rows, at = [], int(start)
                    for key, ids in Reader(file).scan():
                        rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) >= 20_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return listed.mapInPandas(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    frame["doc_id"] = pd.array(frame["doc_id"].tolist(), dtype="Int64")
    return frame


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs to shards in a new folder of the shared scratch space and reads them back."""
    folder = scratch_path(docs.sparkSession, "sst")
    manifest = write(docs, tokenizer, end_id, folder)
    return read(manifest)
