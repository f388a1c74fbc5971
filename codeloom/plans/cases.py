"""Small sources that show how the operators behave where the derived corpus has nothing to say, and what is expected of each, written down by hand.

Each query runs an operator, mostly through its SQL table function, over a whole
table of cases ``(case_id, language, source)``; its SQL lists the expected rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import globs, registry, sqlfuncs
from codeloom.operators import facts, lines
from codeloom.plans.catalogue import _query, _with
from codeloom.plans.code_corpus import code_corpus
from codeloom.sources import files as sources
from codeloom.sources.staging import shared_dir

IMPORTS = [
    ("c", '#include <a.h>\n#include "b.h"\n', ["a.h", "b.h"]),
    ("cpp", '#include <a>\n#include "b.hpp"\n', ["a", "b.hpp"]),
    ("rust", "use a::b;\nuse c::{d, e};\n", ["a::b", "c::{d, e}"]),
    ("python", "import a, b\nfrom c import D\nimport e as f\n", ["a", "b", "c", "e"]),
    ("python", "import a\nimport a\nimport b\n", ["a", "a", "b"]),
    ("javascript", "import a from 'x';\nimport { b } from \"y\";\n", ["x", "y"]),
    ("typescript", "import a from 'x';\nimport b = require(\"y\");\n", ["x", "y"]),
    ("go", 'package p\nimport (\n\t"a/b"\n\t_ "c"\n)\n', ["a/b", "c"]),
    ("java", "import a.B;\nimport static c.D.*;\n", ["a.B", "c.D"]),
    ("csharp", "using A.B;\nusing C;\n", ["A.B", "C"]),
    ("kotlin", "import a.b.*\n", ["a.b"]),
    ("swift", "import Foundation\n", ["Foundation"]),
    ("php", "<?php\nuse A\\B;\nrequire_once 'c.php';\n", ["A\\B", "c.php"]),
    ("php", "<?php\nuse A\\{B, C};\n", ["A", "B", "C"]),
    ("fortran", "program p\n  use iso\n  include 'x.inc'\nend program p\n", ["iso", "x.inc"]),
    ("scala", "import a.b.{C, D}\nimport x.y._\n", ["a.b", "x.y"]),
    ("lua", 'local m = require("a.b")\nfoo.require("c")\n', ["a.b"]),
    ("ada", "with A, B.C;\nuse A;\nprocedure P is begin null; end P;\n", ["A", "B.C"]),
]
_GUARDS = "int first(int a) {\n#ifdef X\n  if (a) {\n#else\n  if (a > 1) {\n#endif\n    one();\n  }\n  return 1;\n}\nint second(int b) {\n  first(b);\n  two();\n  return 0;\n}\n"
CALLS = [
    ("rust", 'fn aid() {}\nfn start() { aid(); std::fs::read("x"); }', [("start", "aid", False), ("start", "std::fs::read", True)]),
    ("python", "def h(): pass\ndef m():\n    h()\n    os.path.join(1)\n", [("m", "h", False), ("m", "os.path.join", True)]),
    ("go", "package p\nfunc h() {}\nfunc m() { h(); fmt.Println(1) }", [("m", "h", False), ("m", "fmt.Println", True)]),
    ("java", "class A { void h() {} void m() { h(); a.b().c(); } }", [("m", "h", False), ("m", "c", True), ("m", "b", True)]),
    ("c", 'void t(int x) {}\nvoid f() { t(1); printf("x"); }', [("f", "t", False), ("f", "printf", True)]),
    ("c", "void t(int x) {}\nvoid f() { void (*p)(int) = t; p(1); }", [("f", "t", False)]),
    ("c", "void t(int x) {}\nvoid f() { void (*p)(int) = &t; p(1); }", [("f", "t", False)]),
    ("c", "void f() { int *p = &x; p(1); }", [("f", "p", True)]),
    ("c", "void t(int x) {}\nvoid f() { void (*p)(int); p = t; p(1); }", [("f", "p", True)]),
    ("c", "int x;", []),
    ("php", "<?php function h() {} function m() { h(); }", []),
    ("javascript", "function o() { function i() { g(); } i(); }", [("o", "g", True), ("o", "i", False), ("i", "g", True)]),
    ("lua", "function h() end\nlocal k = function() a.b() h() end\n", [("k", "a.b", True), ("k", "h", False)]),
]
#: (language, source of a function f, blocks, edges, exits)
CFG = [
    ("c", "int f() { int a; int b; }", 1, [], [0]),
    ("c", "int f() { { { a(); } } }", 1, [], [0]),
    ("c", "int f() { if (x) { a(); } else { b(); } }", 4, [(0, 1, "true_branch"), (0, 2, "false_branch"), (1, 3, "fallthrough"), (2, 3, "fallthrough")], [3]),
    ("c", "int f() { if (x) { return 1; } x = 2; }", 5, [(0, 1, "true_branch"), (1, 2, "return"), (0, 3, "false_branch"), (3, 4, "fallthrough")], [2, 4]),
    ("c", "int f() { while (x) { y(); } }", 4, [(0, 1, "fallthrough"), (1, 2, "false_branch"), (1, 3, "true_branch"), (3, 1, "back_edge")], []),
    ("c", "int f() { for (i = 0; i < 3; i++) { continue; } }", 5, [(0, 1, "fallthrough"), (1, 2, "false_branch"), (1, 3, "true_branch"), (3, 1, "continue")], [4]),
    ("c", "int f() { do a(); while (x); }", 4, [(0, 1, "fallthrough"), (1, 2, "fallthrough"), (2, 1, "back_edge"), (2, 3, "false_branch")], [3]),
    ("rust", "fn f() { loop { return; } }", 4, [(0, 1, "fallthrough"), (1, 3, "return")], [3]),
    ("python", "def f():\n    pass\n", 0, [], []),
]
C_STANDARDS = [
    ("int f(void) { return __alignof__(int); }", None), ("#include <stdbool.h>\nbool b = true;", None), ("int f(int a) { return a; }", None),
    ("void f(int *restrict p);", "C99"), ("struct s a = { .x = 1 };", "C99"), ("int a[] = { [2] = 1 };", "C99"), ("void f(int n, int a[*]);", "C99"),
    ("int f(void) { return _Generic(1, int: 2, default: 3); }", "C11"), ("_Alignas(16) int x;", "C11"), ("int f(void) { return _Alignof(int); }", "C11"), ("_Atomic int x;", "C11"),
    ("_Noreturn void f(void);", "C11"), ('_Static_assert(1, "x");', "C11"), ('#if 0\n_Static_assert(1, "x");\n#endif', "C11"), ("void f(int *restrict p);\n_Atomic int x;", "C11"),
    ("int *p = nullptr;", "C23"), ("constexpr int x = 1;", "C23"), ("[[nodiscard]] int f(void);", "C23"), ('#embed "x.bin"', "C23"),
]
HEADERS = [
    ("#ifndef A\n#define A\nstruct s { int x; };\nint f(struct s *p);\n#endif\n", False), ('static_assert(1, "x");', False), ("", False),
    ("class A {};", True), ("namespace n { int x; }", True), ("template <class T> T f(T a);", True), ("int x = n::y;", True), ("void f(int &a);", True), ("void f() { try { g(); } catch (int e) { } }", True), ("using namespace n;", True),
]
#: (language, source, how many functions, how many different hashes)
FINGERPRINTS = [
    ("c", "int f(int a) { return a + 1; }\nint g(int b) { return b + 2; }", 2, 1),
    ("c", "int f(int a) { return a + 1; }\nint g(int a) { if (a) { return 1; } return 2; }", 2, 2),
    ("c", "int f(int a) { return a + 1; }\nlong g(int a) { return a + 1; }", 2, 2),
    ("rust", "fn a() { fn b() {} }", 2, 2),
    ("python", "def f(a):\n    return a\ndef g(b):\n    return b\n", 2, 1),
    ("c", "int x;", 0, 0),
]
#: (language, source, [(first line, last line, tools)])
REGIONS = [
    ("c", "int a;\n/* tools:off */\nint b;\nint c;\n/* tools:on */\n", [(2, 5, None)]),
    ("c", "// tools:off lynx\nint a;\n// tools:on\n", [(1, 3, "lynx")]),
    ("c", "// tools:off one, two\nint a;\n// tools:on\n", [(1, 3, "one|two")]),
    ("python", "a = 1\n# tools:off\nb = 2\n# tools:on\n", [(2, 4, None)]),
    ("ada", "-- tools:off\nX;\n-- tools:on\n", [(1, 3, None)]),
    ("fortran", "! tools:off\nx = 1\n! tools:on\n", [(1, 3, None)]),
    ("c", "// tools:off\nint a;\n// tools:off\nint b;\n// tools:on\n", [(1, 5, None)]),
    ("c", "int a;\n// tools:off\nint b;\n", [(2, 3, None)]),
    ("c", "// tools:offline\nint a;\n", []),
    ("c", "", []),
    ("lua", "--[[ tools:off ]]\nx = 1\n", []),
    ("c", "// tools:off a　, b\nint a;\n", [(1, 2, "a|b")]),
]
#: (language, source, [(comment line, target line, tool, rule, hash, justification)])
SUPPRESSIONS = [
    ("c", '// tools:suppress Sec:R1 HASH:ab12 JUSTIFICATION:"fine"\nint a;\n', [(1, 2, "Sec", "R1", "ab12", "fine")]),
    ("c", '// tools:suppress sec:R1 JUSTIFICATION:"old, see T 12"\nint a;\n', [(1, 2, "sec", "R1", None, "old, see T 12")]),
    ("c", "// tools:suppress sec:R1\n\n  \nint a;\n", [(1, 4, "sec", "R1", None, None)]),
    ("c", "int a;\n// tools:suppress sec:R1\n", [(2, None, "sec", "R1", None, None)]),
    ("python", "# tools:suppress sec:R2\na = 1\n", [(1, 2, "sec", "R2", None, None)]),
    ("c", "// tools:suppress sec\nint a;\n", []),
    ("c", "// suppress sec:R1\nint a;\n", []),
    ("c", "// tools:suppress sec:R1 HASH:x HASH:y\nint a;\n", [(1, 2, "sec", "R1", "y", None)]),
]
#: (region tools or suppressed tool, asked for, does it match): only ASCII letters fold
MATCHES = [("gauge", "GAUGE", True), ("\u00c9", "\u00e9", False), ("\u212a", "k", False), ("a", "b", False)]
#: The names of the 16 languages' sample files, two of them in a folder to be ignored.
TREE = [f"src/{x.key}.{x.extensions[0]}" for x in registry.LANGUAGES] + ["src/vendor/a.c", "src/deep/vendor/b.py", "src/notes.txt", "src/only.h"]
LOOKUPS = ["c", "cpp", "rust", "tsx", "typescript", "", "txt", "C", "python", "ada", "fortran", "lua"]


def _values(columns: str, rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (bool, int)):
            return str(v)
        return "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


def _cases(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(case_id, language, source) as a view, ready for the SQL functions."""
    sqlfuncs.register(spark)
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "case_id long, language string, source string")
    df.createOrReplaceTempView("cases")
    return df


@_query(_values("case_id, seq, import_source", [(i, k, x) for i, (*_, found) in enumerate(IMPORTS) for k, x in enumerate(found)]))
def case_imports(spark, sf_dir):
    _cases(spark, IMPORTS)
    return spark.sql("SELECT c.case_id, t.seq, t.source AS import_source FROM cases c, LATERAL import_sources(c.language, c.source) t")


@_query(_values("case_id, imports", [(i, len(set(found))) for i, (*_, found) in enumerate(IMPORTS)]))
def case_distinct_imports(spark, sf_dir):
    c = _cases(spark, IMPORTS)
    return facts.distinct_import_counts(c, facts.facts(c, ("imports",), "case_id", grammar="language"), "case_id")


@_query(_values("case_id, seq, caller, callee, is_external", [(i, k, *x) for i, (*_, found) in enumerate(CALLS) for k, x in enumerate(found)]))
def case_calls(spark, sf_dir):
    _cases(spark, CALLS)
    return spark.sql("SELECT c.case_id, t.* FROM cases c, LATERAL call_edges(c.language, c.source) t")


@_query("SELECT TRUE AS second_calls_first, FALSE AS first_calls_itself, FALSE AS first_calls_two")
def case_recovery(spark, sf_dir):
    """Braces opened under two guards: the first function must not swallow the second."""
    _cases(spark, [("c", _GUARDS)])
    has = lambda a, b: F.bool_or((F.col("caller") == a) & (F.col("callee") == b))
    e = spark.sql("SELECT t.* FROM cases c, LATERAL call_edges(c.language, c.source) t")
    return e.agg(has("second", "first").alias("second_calls_first"), has("first", "first").alias("first_calls_itself"), has("first", "two").alias("first_calls_two"))


@_query(_values("case_id, src, dst, kind", [(i, *e) for i, (_, _, _, edges, _) in enumerate(CFG) for e in edges]))
def case_cfg_edges(spark, sf_dir):
    _cases(spark, CFG)
    return spark.sql("SELECT c.case_id, t.src, t.dst, t.kind FROM cases c, LATERAL function_cfg_edges(c.language, c.source, 'f') t")


@_query(_values("case_id, block_count, exits", [(i, n, ",".join(map(str, x))) for i, (_, _, n, _, x) in enumerate(CFG) if n]))
def case_cfg_blocks(spark, sf_dir):
    _cases(spark, CFG)
    b = spark.sql("SELECT c.case_id, t.block_id, t.is_exit FROM cases c, LATERAL function_cfg_blocks(c.language, c.source, 'f') t")
    exits = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_exit"), F.col("block_id")))), lambda x: x.cast("string")), ",")
    return b.groupBy("case_id").agg(F.count("*").alias("block_count"), exits.alias("exits"))


@_query(
    _values(
        "case_id, what, block, n",
        [(i, "successors", 0, sum(a == 0 for a, *_ in e)) for i, (_, _, _, e, _) in enumerate(CFG) if any(a == 0 for a, *_ in e)]
        + [(i, "predecessors", 1, sum(b == 1 for _, b, _ in e)) for i, (_, _, _, e, _) in enumerate(CFG) if any(b == 1 for _, b, _ in e)]
        + [(i, "get_block", 3, 1) for i, (_, _, n, _, _) in enumerate(CFG) if n > 3],
    )
)
def case_cfg_neighbours(spark, sf_dir):
    f = facts.facts(_cases(spark, CFG), ("cfg_blocks", "cfg_edges"), "case_id", grammar="language")
    e, b = facts.cfg_edges(f, "case_id"), facts.cfg_blocks(f, "case_id")
    parts = [("successors", 0, facts.successors(e, 0)), ("predecessors", 1, facts.predecessors(e, 1)), ("get_block", 3, facts.get_block(b, 3))]
    out = [d.groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(what).alias("what"), F.lit(k).alias("block"), "n") for what, k, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query(_values("case_id, standard", [(i, x) for i, (_, x) in enumerate(C_STANDARDS)]))
def case_c_standards(spark, sf_dir):
    _cases(spark, [("c", s) for s, _ in C_STANDARDS])
    return spark.sql("SELECT c.case_id, t.standard FROM cases c, LATERAL min_c_standard(c.source) t")


@_query(_values("case_id, is_cpp", [(i, x) for i, (_, x) in enumerate(HEADERS)]))
def case_headers(spark, sf_dir):
    _cases(spark, [("c", s) for s, _ in HEADERS])
    return spark.sql("SELECT c.case_id, t.looks_like_cpp AS is_cpp FROM cases c, LATERAL looks_like_cpp(c.source) t")


@_query(_values("case_id, functions, hashes", [(i, n, k) for i, (_, _, n, k) in enumerate(FINGERPRINTS) if n]))
def case_fingerprints(spark, sf_dir):
    _cases(spark, FINGERPRINTS)
    return spark.sql("SELECT c.case_id, count(*) AS functions, count(DISTINCT t.hash) AS hashes FROM cases c, LATERAL function_fingerprints(c.language, c.source, 0) t GROUP BY c.case_id")


_REGION_SQL = _values("case_id, line_start, line_end, tools", [(i, *r) for i, (*_, found) in enumerate(REGIONS) for r in found])


@_query(_REGION_SQL)
def case_regions(spark, sf_dir):
    _cases(spark, REGIONS)
    return spark.sql("SELECT c.case_id, t.line_start, t.line_end, array_join(t.tools, '|') AS tools FROM cases c, LATERAL ignored_regions(c.language, c.source) t")


@_query(_REGION_SQL)
def case_regions_in_tables(spark, sf_dir):
    c = _cases(spark, REGIONS).withColumn("sloc_mode", registry.sloc_mode_of_key(F.col("language")))
    return lines.ignored_regions(c, "case_id").select("case_id", "line_start", "line_end", F.array_join("tools", "|").alias("tools"))


_SUPPRESS_SQL = _values("case_id, comment_line, target_line, tool, rule, hash, justification", [(i, *r) for i, (*_, found) in enumerate(SUPPRESSIONS) for r in found])


@_query(_SUPPRESS_SQL)
def case_suppressions(spark, sf_dir):
    _cases(spark, SUPPRESSIONS)
    return spark.sql("SELECT c.case_id, t.* FROM cases c, LATERAL suppressions(c.language, c.source) t")


@_query(_SUPPRESS_SQL)
def case_suppressions_in_tables(spark, sf_dir):
    c = _cases(spark, SUPPRESSIONS).withColumn("sloc_mode", registry.sloc_mode_of_key(F.col("language")))
    return lines.suppressions(c, "case_id")


@_query(_values("held, asked, in_region, in_suppression", [(a, b, m, m) for a, b, m in MATCHES]))
def case_tool_names(spark, sf_dir):
    out = None
    for a, b, _ in MATCHES:
        row = spark.createDataFrame([(a, b)], "held string, asked string")
        row = row.select("held", "asked", lines.region_applies_to(F.array("held"), b).alias("in_region"), lines.suppression_applies_to(F.col("held"), F.lit("R"), b, "R").alias("in_suppression"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- lookups, files


@_query(f"SELECT ord, key, name FROM ({_values('ord, key, name', [(i, x.key, x.name) for i, x in enumerate(registry.LANGUAGES)])})")
def languages_in_sql(spark, sf_dir):
    sqlfuncs.register(spark)
    return spark.sql("SELECT ord, key, name FROM languages()")


@_query(
    "SELECT doc_id, k AS key, CASE WHEN k IN ('', 'txt', 'C') THEN NULL ELSE k END AS grammar, CASE WHEN k IN ('', 'txt', 'C', 'tsx') THEN NULL WHEN k = 'python' THEN 'Python' WHEN k = 'ada' THEN 'Ada' WHEN k = 'fortran' THEN 'Fortran' WHEN k = 'lua' THEN 'Lua' ELSE 'Default' END AS sloc_mode "
    + f"FROM (SELECT doc_id, {LOOKUPS}[doc_id % {len(LOOKUPS)} + 1] AS k FROM documents)"
)
def key_lookups(spark, sf_dir):
    key = F.element_at(F.array(*map(F.lit, LOOKUPS)), (F.col("doc_id") % len(LOOKUPS) + 1).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", key.alias("key"))
    return d.select("doc_id", "key", registry.grammar_of_key(F.col("key")).alias("grammar"), registry.sloc_mode_of_key(F.col("key"), strict=False).alias("sloc_mode"))


@_query(_with("SELECT file_id, FALSE AS ignored FROM c"))
def nothing_ignored(spark, sf_dir):
    return code_corpus(spark, sf_dir).select("file_id", globs.is_ignored(F.col("path"), []).alias("ignored"))


@_query(_values("name, language", [(f"{x.key}.{x.extensions[0]}", x.key) for x in registry.LANGUAGES]))
def tree_of_files(spark, sf_dir):
    """A directory tree, written file by file into the shared folder, and what a walk finds in it."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in TREE:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(b"x\n"))
        out.close()
    found = sources.read_tree(spark, root, ignore=["**/vendor/**"])
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "language")


@_query(_with("SELECT relation, count(*) AS n FROM c, (VALUES ('imports'), ('functions'), ('functions')) AS x(relation) GROUP BY relation"))
def facts_written_and_read(spark, sf_dir):
    """Relations in a sink partitioned by relation; the reader prunes to the ones it wants."""
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    sources.write_by(facts.facts(code_corpus(spark, sf_dir, spread=True), ("imports", "functions", "calls")), path, "relation")
    return spark.read.parquet(path).where(F.col("relation").isin("imports", "functions") & F.col("a").isNotNull()).groupBy("relation").agg(F.count("*").alias("n"))


@_query(_with("SELECT language, count(*) * 2 AS functions, CAST(0 AS BIGINT) AS macro_like FROM c GROUP BY language"))
def functions_by_language(spark, sf_dir):
    f = facts.functions(facts.facts(code_corpus(spark, sf_dir, spread=True), ("functions",)))
    files = code_corpus(spark, sf_dir).select("file_id", "language")
    return f.where("name is not null").join(files, "file_id").groupBy("language").agg(F.count("*").alias("functions"), F.sum(F.col("is_macro_like").cast("long")).alias("macro_like"))
