"""Source trees and tables in, relations out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import globs, registry


def discover(files: DataFrame, ignore: list[str] | None = None, path: str = "path", explicit: bool = False) -> DataFrame:
    """Source files only (``explicit``: all that can be parsed), without ignored paths, with ``language, grammar, sloc_mode``. All before any parse."""
    ext = registry.extension_of(F.col(path))
    keep: Column = registry.is_parseable_ext(ext) if explicit else registry.is_source_ext(ext)
    return registry.with_language(files.where(keep & ~globs.is_ignored(F.col(path), ignore or [])), path)


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, explicit: bool = False) -> DataFrame:
    """``file_id, path, source, language, grammar, sloc_mode`` of a directory tree; bytes that are not UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    found = discover(raw, ignore, explicit=explicit)
    return found.select(F.xxhash64("path").alias("file_id"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"), "language", "grammar", "sloc_mode")


def from_table(df: DataFrame, file_id: str, path: str, source: str) -> DataFrame:
    return registry.with_language(df.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.col(source).alias("source")))


def write_by(df: DataFrame, path: str, *partition: str, mode: str = "errorifexists") -> None:
    """Parquet, partitioned so that later reads prune (facts by ``relation``, nodes by ``grammar``)."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)
