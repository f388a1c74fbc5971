"""The language table and lookups over it, as Columns that Catalyst can fold and prune with."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Language(NamedTuple):
    key: str
    name: str
    extensions: tuple[str, ...]
    explicit_only: tuple[str, ...]
    sloc_mode: str


LANGUAGES = tuple(
    Language(key, name, tuple(ext.split()), tuple(extra.split()), mode)
    for key, name, ext, extra, mode in (
        ("c", "C", "c", "h", "Default"),
        ("cpp", "C++", "cpp cc cxx hpp hxx", "", "Default"),
        ("rust", "Rust", "rs", "", "Default"),
        ("python", "Python", "py", "", "Python"),
        ("javascript", "JavaScript", "js mjs cjs jsx", "", "Default"),
        ("typescript", "TypeScript", "ts tsx", "", "Default"),
        ("ada", "Ada", "adb ada", "ads", "Ada"),
        ("go", "Go", "go", "", "Default"),
        ("java", "Java", "java", "", "Default"),
        ("csharp", "C#", "cs", "", "Default"),
        ("kotlin", "Kotlin", "kt kts", "", "Default"),
        ("swift", "Swift", "swift", "", "Default"),
        ("php", "PHP", "php", "", "Default"),
        ("fortran", "Fortran", "f90 f95 f03 f08 F90 F95 F03 F08", "", "Fortran"),
        ("scala", "Scala", "scala sc", "", "Default"),
        ("lua", "Lua", "lua", "", "Lua"),
    )
)

BY_EXTENSION = {e: lang for lang in reversed(LANGUAGES) for e in lang.extensions + lang.explicit_only}
GRAMMARS = {lang.key: lang.key for lang in LANGUAGES} | {"tsx": "tsx"}
SLOC_MODES = ("Default", "Python", "Ada", "Fortran", "Lua")


def _lookup(value: Column, table: dict[str, str]) -> Column:
    """A map literal: unknown values give NULL."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def extension_of(path: Column) -> Column:
    """What follows the last dot of the file name; NULL for no name, a dotfile or a trailing dot."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]*)/*$", 1), F.lit(""))


def grammar_of(path: Column) -> Column:
    """Grammar for a path: by extension, case-sensitive; ``tsx`` has a grammar of its own."""
    ext = extension_of(path)
    return F.when(ext == "tsx", F.lit("tsx")).otherwise(_lookup(ext, {e: lang.key for e, lang in BY_EXTENSION.items()}))


def language_key_of(path: Column) -> Column:
    return _lookup(extension_of(path), {e: lang.key for e, lang in BY_EXTENSION.items()})


def grammar_of_key(key: Column) -> Column:
    return _lookup(key, GRAMMARS)


def grammar_of_header(path: Column, is_cpp: Column) -> Column:
    """Like :func:`grammar_of`, but a ``.h`` file with C++-only content is C++."""
    return F.when((extension_of(path) == "h") & is_cpp, F.lit("cpp")).otherwise(grammar_of(path))


def sloc_mode_of(path: Column) -> Column:
    return _lookup(extension_of(path), {e: lang.sloc_mode for e, lang in BY_EXTENSION.items()})


def sloc_mode_of_key(key: Column, strict: bool = True) -> Column:
    """``tsx`` and other unknown keys raise if ``strict``, else give NULL."""
    mode = _lookup(key, {lang.key: lang.sloc_mode for lang in LANGUAGES})
    if not strict:
        return mode
    return F.when(mode.isNull() & key.isNotNull(), F.raise_error(F.concat(F.lit("unknown language key: "), key)).cast("string")).otherwise(mode)


def is_source_ext(ext: Column) -> Column:
    return ext.isin([e for lang in LANGUAGES for e in lang.extensions])


def is_parseable_ext(ext: Column) -> Column:
    return ext.isin(list(BY_EXTENSION))


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, lang.name, lang.key, list(lang.extensions), list(lang.explicit_only), lang.sloc_mode) for i, lang in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "ord int, name string, key string, extensions array<string>, explicit_only array<string>, sloc_mode string")


def with_language(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with ``language, grammar, sloc_mode`` of its path column."""
    c = F.col(path)
    return df.withColumns({"language": language_key_of(c), "grammar": grammar_of(c), "sloc_mode": sloc_mode_of(c)})


def report_lines(spark: SparkSession) -> DataFrame:
    """``ord, line``: the report's lines, heading first."""
    width = max(len(lang.name) for lang in LANGUAGES)
    dotted = F.array_join(F.transform("extensions", lambda e: F.concat(F.lit("."), e)), " ")
    extra = F.array_join(F.transform("explicit_only", lambda e: F.concat(F.lit("."), e)), " ")
    line = F.concat(F.lit("  "), F.rpad("name", width, " "), F.lit("  "), dotted, F.when(F.size("explicit_only") > 0, F.concat(F.lit("  (also "), extra, F.lit(" when passed explicitly)"))).otherwise(F.lit("")))
    head = spark.createDataFrame([(-1, "Supported languages:")], "ord int, line string")
    return head.unionByName(languages(spark).select("ord", line.alias("line")))


def supported_languages_report(spark: SparkSession) -> str:
    return "".join(r["line"] + "\n" for r in report_lines(spark).orderBy("ord").collect())
