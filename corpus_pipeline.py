"""Corpus pipeline: raw documents to packed training sequences.

Stages, in order, each on all that the one before it kept:

1. quality rules: lines that break a rule are taken out, rejected documents go;
2. n-gram Jaccard join: near duplicates (5-word shingles, similarity 0.8) are grouped, one of each group stays;
3. suffix-array dedup: passages of 200 bytes that also start elsewhere are taken out;
4. packing: token ids of the remaining texts, packed into sequences of 1024.

All but the last return the columns of documents.

Nulls, empties and ties: null and empty texts, and texts of fewer than 50 words, are rejected by the first stage. Of
equal or near documents the one of least doc_id stays (a null doc_id counts as the largest); rows of one doc_id and
text are one document. A document whose whole text repeats elsewhere goes. Texts of any length are read whole. An empty
table gives no rows. Other columns are carried up to packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paceline.llm import ngram_join, packing, quality_rules, suffix_dedup
from paceline.llm.common import stored, table, tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, threshold=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, length=200)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", pack),
]

#: SQL can't express token ids or byte-wise passages; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
