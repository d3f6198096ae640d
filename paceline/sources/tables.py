"""Sources and sinks: text tables, aliases of columns, optional paths, partitioned writes and content digests."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions.scalars import first_filled


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header as strings, nulls empty, a byte order mark taken off the first name."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def read_first(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first of several Parquet paths that exists, else an empty frame."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Logical columns from the physical names that are there; the first filled one wins, empty without any."""
    out = []
    for name, physical in aliases.items():
        there = [F.col(f"`{c}`").cast("string") for c in physical if c in df.columns]
        out.append(first_filled(*there).alias(name) if there else F.lit("").alias(name))
    return df.select(*out)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def write_by(df: DataFrame, path: str, partition: str, *order: str) -> None:
    """One directory for each value, rows in order, the old content replaced when the new one is whole."""
    spark = df.sparkSession
    keyed = df.repartition(partition).sortWithinPartitions(partition, *order)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    whole, fresh, old = (jpath(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    keyed.write.mode("overwrite").partitionBy(partition).parquet(fresh.toString())
    fs = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(whole):
        fs.rename(whole, old)
    fs.rename(fresh, whole)
    fs.delete(old, True)


def write_csv(df: DataFrame, path: str) -> None:
    """Text files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document for each row, keys with null values kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def first_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several text tables that exists, else an empty one of the schema."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.read.option("header", True).schema(schema).csv(path)
    return spark.createDataFrame([], schema)


def content_digest(df: DataFrame) -> str:
    """A digest of the rows as a multiset: files and order don't matter."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
    r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(2**31 - 1))).alias("a"), F.bit_xor(row).alias("b")).first()
    return f"{r['n']}-{r['a'] or 0}-{r['b'] or 0}"


class _Table(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int]]] = []
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th", "li") or tag == "p":
            self._close()
            if tag in ("li", "p") or not self.rows:
                self.rows.append([])
            self.cell, self.span = [], int(dict(attrs).get("colspan") or 1) if str(dict(attrs).get("colspan") or 1).isdigit() else 1

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "li", "p", "table", "ul"):
            self._close()

    def _close(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((" ".join("".join(self.cell).split()), self.span))
            self.cell = None


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of tables and lists in pages: key, row, header (a full-width cell carried down) and cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, page in zip(f[key], f[html]):
                parser = _Table()
                parser.feed(page or "")
                parser.close()
                header = ""
                for i, row in enumerate(parser.rows):
                    if len(row) == 1 and row[0][1] > 1:
                        header = row[0][0]
                    elif row:
                        out.append((k, i, header, [c for c, _ in row]))
            yield pd.DataFrame(out, columns=["key", "row", "header", "cells"])

    return pages.select(key, html).mapInPandas(run, f"key {pages.schema[key].dataType.simpleString()}, row long, header string, cells array<string>")
