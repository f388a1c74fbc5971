"""Five stages over ``documents``, each written as Parquet and reread as the next one's input.

All but the last return the columns of their input, extra ones too.  A null
``doc_id`` is no reason to go (no stage can name it); null and empty texts stay
until a document of theirs is judged on its own text; repeated rows share their
fate; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, line_dedup, mixing, ngram_join, stage, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: fits on ``labels``, then documents that it rejects go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: lines that three documents share stay only in the largest ``doc_id``; documents of which no word is left go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near duplicates the smallest ``doc_id`` stays."""
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a passage of ``benchmark`` go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: how many words of each remaining document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: A trained network and a decomposition are not SQL; tests/llm/test_decontaminate_and_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.written(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
