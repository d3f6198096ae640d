"""Helpers shared by the operators: tables, let-binding for native expressions, shared scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a Java or Python character class (without brackets).
SPACE = "\\x20\\x09-\\x0D"
#: The same characters as text, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; plain reuse of a column would be inlined into lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the cluster names none (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = jsc.getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="paceline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session's settings for what is run meanwhile; the former ones hold again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the files of stored() tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Characters of text that one block of documents holds, about.
BLOCK_CHARS = 6_000_000


def _spark_hash(x: int) -> int:
    """Spark's hash of an int (Murmur3, seed 42), which names the partition that a key goes to."""
    mask = 0xFFFFFFFF
    k = x * 0xCC9E2D51 & mask
    k = (k << 15 | k >> 17) & mask
    h = 42 ^ (k * 0x1B873593 & mask)
    h = (h << 13 | h >> 19) & mask
    h = (h * 5 + 0xE6546B64) & mask
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_keys(many: int, n: int) -> list[int]:
    """many int keys of which hash partitioning puts the same number into each of n partitions."""
    each, loads, out, x = -(-many // n), [0] * n, [], 0
    while len(out) < many:
        p = _spark_hash(x) % n
        if loads[p] < each:
            loads[p] += 1
            out.append(x)
        x += 1
    return out


#: Bytes of rows that a task gathers before it packs them by block.
PACK_BYTES = 32_000_000


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of each block as one compressed Arrow stream."""
    rows = pa.Table.from_batches(batches)
    block = rows["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    rows, block = rows.drop_columns(["block"]).take(order), block[order]
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])).tolist()
    data = []
    for a, b in zip(edges, edges[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.slice(a, b - a))
        data.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]], pa.int32()), pa.array(data, pa.binary())], ["block", "rows"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > PACK_BYTES:
            yield _packed(held)
            held, size = [], 0
    if held:
        yield _packed(held)


def block_table(packed: Iterable[bytes]) -> pa.Table:
    """The rows of a block, from the streams that were dealt to it."""
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(x)).read_all() for x in packed])


def block_rows(f: pd.DataFrame) -> pd.DataFrame:
    """The same as a pandas frame, identifiers exact where some are null; empty if nothing was dealt."""
    if not len(f):
        return pd.DataFrame({"doc_id": [], "text": []})
    return block_table(f["rows"]).to_pandas(integer_object_nulls=True)


def in_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS, carry: bool = False, hashed: bool = False) -> DataFrame:
    """(block, rows) dealt out by block: rows packs doc_id and text (never null) of some of the block's documents, to
    be read by block_rows or block_table; with carry also rest, a struct of all other columns, with hashed text_hash.

    Rows are dealt by doc_id and text, which any run of the plan repeats, so copies of a text, or rows of one
    identifier, spread over blocks. Every shuffle partition gets as many blocks. What is shuffled is packed before,
    at about half the size that Spark's own shuffle would write.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    many = n * max(1, -(-size // (n * block_chars)))
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("rest")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        *(more if carry and len(docs.columns) > 2 else []),
    )
    if hashed:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(int(many))).cast("int")
    if many <= 20_000:
        dealt = F.get(F.lit(even_keys(many, n)), dealt).cast("int")
    out = rows.withColumn("block", dealt).mapInArrow(_pack, "block int, rows binary").repartition(n, "block")
    out.text_bytes = size
    return out


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
