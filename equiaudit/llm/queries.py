"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from equiaudit.llm.byte_bpe import encode_decode
from equiaudit.llm.common import table
from equiaudit.llm.exact_dedup import exact_dedup
from equiaudit.llm.langid import language_id
from equiaudit.llm.line_dedup import line_counts
from equiaudit.llm.mixture import mixture
from equiaudit.llm.near_dedup import near_duplicates
from equiaudit.llm.packing import pack
from equiaudit.llm.quality import quality_cascade
from equiaudit.llm.resampling import resample
from equiaudit.llm.substring_dedup import remove_repeats
from equiaudit.llm.toxicity import toxicity
from equiaudit.llm.warc import pages_through_archives
from equiaudit.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_through_archives(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_cascade(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_warc, op2_near_dedup, op3_line_dedup, op4_language_id, op5_packing, op6_mixture, op7_quality_cascade,
    op8_substring_dedup, op9_toxicity, op10_exact_dedup, op11_whitening, op12_resampling,
    op13_byte_bpe)}
