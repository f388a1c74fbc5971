"""The same operators over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.registry import with_language
from codeloom.operators import facts


def read_stream(spark: SparkSession, folder: str, schema: str = "file_id long, path string, source string", **options: str) -> DataFrame:
    """Parquet files of sources as they appear in a folder."""
    return with_language(spark.readStream.schema(schema).options(**options).parquet(folder))


def stream_facts(files: DataFrame, relations=facts.RELATIONS) -> DataFrame:
    """Stateless: each micro-batch is parsed once; append mode."""
    return facts.facts(files, relations)


def duplicate_counts(fingerprints: DataFrame) -> DataFrame:
    """Running group sizes by hash (update or complete mode); state is one count a hash."""
    return fingerprints.groupBy("hash").agg(F.count("*").alias("group_size"))
