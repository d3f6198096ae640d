"""The queries of this subpackage: thin functions that bind the operators to the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from paceline.llm import fingerprints, html_crf, katz, ngram_join, packing, quality_rules, sstable, suffix_dedup, url_filters, word_table
from paceline.llm.common import table, tokenizer_file
from paceline.llm.oracles import ORACLES

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), held_out=lambda doc_id: katz.fold(doc_id) == 2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, length=1024)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_pages(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(table(spark, sf_dir, "documents"), n=4, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_katz": op2_katz,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_sstable": op5_sstable,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_crf": op7_html_crf,
    "op8_bpe": op8_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_ngram_join": op10_ngram_join,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**ORACLES, **own}
