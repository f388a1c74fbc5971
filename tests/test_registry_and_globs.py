import pytest
from pyspark.sql import functions as F

from codeloom.functions import globs, registry


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, grammar, key, mode",
    [("a.c", "c", "c", "Default"), ("x.h", "c", "c", "Default"), ("a.tsx", "tsx", "typescript", "Default"), ("q.F90", "fortran", "fortran", "Fortran"), ("d/e.py", "python", "python", "Python"), ("s.ads", "ada", "ada", "Ada"), (".c", None, None, None), ("foo.", None, None, None), ("a.b/c", None, None, None), ("notes.txt", None, None, None), ("A.C", None, None, None)],
)
def test_lookups_by_path(spark, path, grammar, key, mode):
    p = F.lit(path)
    assert value(spark, registry.grammar_of(p)) == grammar
    assert value(spark, registry.language_key_of(p)) == key
    assert value(spark, registry.sloc_mode_of(p)) == mode


def test_keys_and_headers(spark):
    assert value(spark, registry.grammar_of_key(F.lit("tsx"))) == "tsx"
    assert value(spark, registry.grammar_of_key(F.lit("C"))) is None
    assert value(spark, registry.grammar_of_header(F.lit("a.h"), F.lit(True))) == "cpp"
    assert value(spark, registry.grammar_of_header(F.lit("a.c"), F.lit(True))) == "c"
    assert value(spark, registry.sloc_mode_of_key(F.lit("tsx"), strict=False)) is None
    with pytest.raises(Exception, match="unknown language key"):
        value(spark, registry.sloc_mode_of_key(F.lit("tsx")))


def test_every_extension_resolves_and_keys_are_unique():
    assert len({x.key for x in registry.LANGUAGES}) == 16
    assert sum(len(x.extensions) for x in registry.LANGUAGES) == 34
    assert {e for x in registry.LANGUAGES for e in x.explicit_only} == {"h", "ads"}


def test_source_and_parseable(spark):
    for ext, source, parseable in (("h", False, True), ("ads", False, True), ("rs", True, True), ("txt", False, False)):
        assert value(spark, registry.is_source_ext(F.lit(ext))) is source
        assert value(spark, registry.is_parseable_ext(F.lit(ext))) is parseable


def test_report(spark):
    text = registry.supported_languages_report(spark)
    assert text.startswith("Supported languages:\n  C           .c  (also .h when passed explicitly)\n")
    assert all(x.name in text for x in registry.LANGUAGES)


@pytest.mark.parametrize(
    "patterns, path, ignored",
    [(["vendor/**", "deps/**"], "vendor/a/b.c", True), (["vendor/**"], "vendor", False), (["vendor/**"], "src/main.rs", False), ([], "anything", False), (["**/x.c"], "x.c", True), (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True), (["*.c"], "a/b.c", True), (["[!a]x"], "ax", False), (["{a,b}.c"], "b.c", True), (["a?c"], "a/c", True), (["\\*.c"], "*.c", True), (["\\*.c"], "a.c", False), (["[]]"], "]", True)],
)
def test_globs(spark, patterns, path, ignored):
    assert value(spark, globs.is_ignored(F.lit(path), patterns)) is ignored


@pytest.mark.parametrize("bad", ["[", "{a", "a}", "[z-a]", "a\\"])
def test_bad_globs(bad):
    with pytest.raises(ValueError):
        globs.compile_globs([bad])
