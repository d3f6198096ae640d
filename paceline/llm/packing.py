"""Packing of tokenized documents into sequences of a fixed length (shortest pack first, over the histogram).

Documents are cut into full pieces and one remainder each. The histogram of remainder lengths, at most
``length`` rows, is packed on the driver: lengths are placed longest first, each into the packing patterns with
the most room left, whose counts are updated. Patterns then become ranges of ranks, and pieces find their place
by their rank among pieces of the same length.

The number of patterns is bounded: placing one length turns whole patterns into others, divides at most one, and
opens at most one, so there are at most 2 * length patterns and length slots in each.

Nulls, empties and ties: a null or empty text is one document of the end id alone. Repeated rows are packed
each by itself. Pieces of one length take ranks by task and row order, which any run of the plan may choose
differently; every choice gives a packing of the same shape. An empty table gives no pieces. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import settings, stored
from paceline.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local long"
COLUMNS = [c.split()[0] for c in PIECES.split(", ")]
KINDS = [pa.int32() if c.endswith(" int") else pa.int64() for c in PIECES.split(", ")]
#: Bytes of rows that Spark hands over at once (64 MB by its own setting, which JVM and worker each hold more than once).
BATCH_BYTES = 4_000_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """The pieces of every document, each with its rank among its task's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder("byte", tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            rows = []
            for doc_id, ids in zip(doc_ids, encode.encode([t or "" for t in texts])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    n = len(piece)
                    rows.append((doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), part, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], COLUMNS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack_histogram(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of one sequence) patterns that hold every piece of the histogram once."""
    rooms: dict[int, list[list]] = {}
    heap: list[int] = []

    def put(room: int, count: int, items: tuple[int, ...]) -> None:
        if room not in rooms:
            rooms[room] = []
            heapq.heappush(heap, -room)
        rooms[room].append([count, items])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        placed: list[tuple[int, int, tuple[int, ...]]] = []
        while left and heap and -heap[0] >= size:
            room = -heap[0]
            count, items = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                heapq.heappop(heap)
            taken = min(left, count)
            if taken < count:
                put(room, count - taken, items)
            placed.append((room - size, taken, (*items, size)))
            left -= taken
        for room, count, items in placed:
            put(room, count, items)
        while left:
            fit = min(length // size, left)
            whole = left // fit
            put(length - fit * size, whole, (size,) * fit)
            left -= fit * whole
    return [(count, items) for found in rooms.values() for count, items in found]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(piece length, first rank, end rank, first sequence, offset): where ranks of each length go."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, items in patterns:
        offset = 0
        for size in items:
            first = rank.get(size, 0)
            out.append((size, first, first + count, sequence, offset))
            rank[size] = first + count
            offset += size
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}):
        cut = stored(pieces(docs, tokenizer, end_id, length), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = stored(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(pack_histogram(histogram, length))
    table = spark.createDataFrame(places, "length long, low long, high long, sequence long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    fits = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.alias("p").join(F.broadcast(table).alias("s"), fits).select(
        "doc_id", "start", "p.length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
    )
