"""The registered query of each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grafthorn.llm.common import table
from grafthorn.llm.decontam import contaminated
from grafthorn.llm.divergence import divergences
from grafthorn.llm.html_text import extracted
from grafthorn.llm.language_model import document_scores
from grafthorn.llm.licenses import licenses
from grafthorn.llm.media import text_as_media
from grafthorn.llm.ngram_join import near_duplicates
from grafthorn.llm.packing import packed, token_pieces
from grafthorn.llm.passages import repeated_passages
from grafthorn.llm.pii import pii_spans
from grafthorn.llm.resampling import resampled
from grafthorn.llm.sql import OP11
from grafthorn.llm.toxicity import toxicity
from grafthorn.llm.warc import deduplicated_archive


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archive(table(spark, sf_dir, "pages"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_as_media(table(spark, sf_dir, "documents"))


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_license_scans": op7_license_scans,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_media_columns": op10_media_columns,
    "op11_source_divergence_audit": op11_source_divergence_audit,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_lm_scoring": op13_lm_scoring,
}
ORACLES: dict[str, str] = {"op11_source_divergence_audit": OP11}
