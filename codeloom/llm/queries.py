"""The queries of this subpackage: ``QUERIES[name](spark, sf_dir)`` and, where SQL can say the same, ``SQL[name]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import chat, ctw, decontaminate, html_text, line_dedup, mixing, ngram_join, quality, toxicity, weak_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(_table(spark, sf_dir, "conversations"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(_table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.weak_quality(_table(spark, sf_dir, "documents"))


QUERIES = {"op5_weak_quality": op5_weak_quality, "op1_decontamination": op1_decontamination, "op2_ctw_score": op2_ctw_score, "op6_toxicity": op6_toxicity, "op3_ngram_jaccard": op3_ngram_jaccard, "op9_html_text": op9_html_text, "op7_chat_format": op7_chat_format, "op4_quality_rules": op4_quality_rules, "op8_mixing": op8_mixing, "op10_line_dedup": op10_line_dedup}
SQL = {"op3_ngram_jaccard": ngram_join.SQL, "op7_chat_format": chat.SQL, "op8_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL}
