"""A code corpus derived from ``documents.doc_id``, and closed forms of what the operators must find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.registry import LANGUAGES, with_language

#: Files that a task parses, about half a second's work; fewer where that leaves cores idle.
TASK_FILES = 2048
KEYS = [lang.key for lang in LANGUAGES]
EXTENSIONS = [lang.extensions[0] for lang in LANGUAGES]
PREFIX = {"python": "#", "ada": "--", "lua": "--", "fortran": "!"}

_C_BODIES = ("x = x + 1;", "if (x) { x = 7; } else { x = 8; }", "if (x) { return 1; } x = 2;", "while (x) { if (x > 3) { break; } x = x + 1; }", "for (x = 0; x < 3; x++) { continue; }")
_RUST_BODIES = ("x = x + 1;", "if x > 1 { x = 7; } else { x = 8; }", "if x > 1 { return; } x = 2;", "while x > 1 { if x > 3 { break; } x = x + 1; }", "loop { return; }")
#: @F: function number, @G: the one it calls elsewhere, @M: module number, @B: body, @S: marker of a C standard or of C++.
TEMPLATES = {
    "c": '#include "mod@M.h"\n@S\nint helper@F(int a) { return a; }\nint main@F(int x) {\n  helper@F(x);\n  main@G(x);\n  @B\n}\n',
    "cpp": "#include <mod@M.h>\n@S\nint helper@F(int a) { return a; }\nint main@F(int x) {\n  helper@F(x);\n  main@G(x);\n  @B\n}\n",
    "rust": "use crate::mod@M;\nfn helper@F(a: i32) -> i32 { a }\nfn main@F(mut x: i32) {\n  helper@F(x);\n  main@G(x);\n  @B\n}\n",
    "python": "import mod@M\ndef helper@F(a):\n    return a\n\ndef main@F(x):\n    helper@F(x)\n    return main@G(x)\n",
    "javascript": "import m from './mod@M';\nfunction helper@F(a) { return a; }\nfunction main@F(x) { helper@F(x); return main@G(x); }\n",
    "typescript": "import m from './mod@M';\nfunction helper@F(a: number): number { return a; }\nfunction main@F(x: number) { helper@F(x); return main@G(x); }\n",
    "ada": "with Mod@M;\nprocedure main@F is\n  procedure helper@F is\n  begin\n    null;\n  end helper@F;\nbegin\n  helper@F;\n  main@G(1);\nend main@F;\n",
    "go": 'package p\nimport "x/mod@M"\nfunc helper@F(a int) int { return a }\nfunc main@F(x int) {\n\thelper@F(x)\n\tmain@G(x)\n}\n',
    "java": "import x.mod@M;\nclass A {\n  int helper@F(int a) { return a; }\n  void main@F(int x) { helper@F(x); main@G(x); }\n}\n",
    "csharp": "using X.Mod@M;\nclass A {\n  int helper@F(int a) { return a; }\n  void main@F(int x) { helper@F(x); main@G(x); }\n}\n",
    "kotlin": "import x.mod@M\nfun helper@F(a: Int): Int { return a }\nfun main@F(x: Int) {\n  helper@F(x)\n  main@G(x)\n}\n",
    "swift": "import mod@M\nfunc helper@F(a: Int) -> Int { return a }\nfunc main@F(x: Int) {\n  helper@F(x)\n  main@G(x)\n}\n",
    "php": "<?php\nuse X\\Mod@M;\nfunction helper@F($a) { return $a; }\nfunction main@F($x) { helper@F($x); main@G($x); }\n",
    "fortran": "subroutine main@F(x)\n  use mod@M\n  x = helper@F(x)\n  x = main@G(x)\nend subroutine main@F\ninteger function helper@F(a)\n  helper@F = a\nend function helper@F\n",
    "scala": "import x.mod@M\nobject A {\n  def helper@F(a: Int): Int = { a }\n  def main@F(x: Int): Unit = {\n    helper@F(x)\n    main@G(x)\n  }\n}\n",
    "lua": 'local m = require("mod@M")\nfunction helper@F(a) return a end\nfunction main@F(x) helper@F(x) main@G(x) end\n',
}
_C_MARKS = ("", "void r(int *restrict p);", '_Static_assert(1, "x");', "[[nodiscard]] int q(void);")
_CPP_MARKS = ("", "namespace n { int v; }")


def code_corpus(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``file_id, path, lang_ix, fn_ix, mod_ix, body_ix, source, language, grammar, sloc_mode`` for every row of ``documents``.

    ``spread``: for a parse, which costs far more than the scan, ids are spread
    over the cores first; the sources made of them don't move.  The number of
    tasks is given: ids take so few bytes that adaptive execution would leave
    millions of files to one task.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"))
    if spread:
        n = d.count()  # from the footers
        d = d.repartition(max(-(-n // TASK_FILES), min(n, spark.sparkContext.defaultParallelism), 1), "file_id")
    d = d.select("file_id", (F.col("file_id") % 16).alias("lang_ix"), (F.col("file_id") % 97).alias("fn_ix"), (F.col("file_id") % 13).alias("mod_ix"), (F.col("file_id") % 5).alias("body_ix"))

    def choose(values, ix):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (ix + 1).cast("int"))

    lang = F.col("lang_ix")
    body = F.when(lang == KEYS.index("rust"), choose(_RUST_BODIES, F.col("body_ix"))).otherwise(choose(_C_BODIES, F.col("body_ix")))
    mark = F.when(lang == KEYS.index("cpp"), choose(_CPP_MARKS, F.floor(F.col("file_id") / 16) % 2)).otherwise(choose(_C_MARKS, F.floor(F.col("file_id") / 16) % 4))
    prefix = choose([PREFIX.get(k, "//") for k in KEYS], lang)
    kind = F.col("file_id") % 3
    head = F.when(kind == 0, F.concat(prefix, F.lit(" tools:off scans\n"), prefix, F.lit(" note\n"), prefix, F.lit(" tools:on\n")))
    head = head.when(kind == 1, F.concat(prefix, F.lit(" tools:suppress sec:R"), F.col("mod_ix").cast("string"), F.lit(" HASH:h"), F.col("fn_ix").cast("string"), F.lit(' JUSTIFICATION:"a, b"\n\n'))).otherwise("")
    text = choose([TEMPLATES[k] for k in KEYS], lang)
    for tag, value in (("@F", F.col("fn_ix")), ("@G", (F.col("fn_ix") * 64 + 1) % 97), ("@M", F.col("mod_ix")), ("@B", body), ("@S", mark)):
        text = F.replace(text, F.lit(tag), value.cast("string"))
    path = F.concat(F.when(F.col("file_id") % 7 == 0, "vendor/d").otherwise("src/d"), (F.col("file_id") % 7).cast("string"), F.lit("/f"), F.col("file_id").cast("string"), F.lit("."), choose(EXTENSIONS, lang))
    return with_language(d.select("*", path.alias("path"), F.concat(head, text).alias("source")))


def case(column: str, values: dict[str, str], default: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


_KEY_LIST = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_EXT_LIST = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
#: The corpus for DuckDB, by its parameters alone.
CORPUS_SQL = f"""
c AS (
  SELECT doc_id AS file_id, {_KEY_LIST}[doc_id % 16 + 1] AS language, {_EXT_LIST}[doc_id % 16 + 1] AS ext, doc_id % 97 AS f, (doc_id % 97 * 64 + 1) % 97 AS g,
         doc_id % 13 AS m, doc_id % 5 AS b, doc_id % 3 AS head, doc_id // 16 AS r FROM documents
)"""
IMPORT_SQL = case("language", {"c": "'mod' || m || '.h'", "cpp": "'mod' || m || '.h'", "rust": "'crate::mod' || m", "javascript": "'./mod' || m", "typescript": "'./mod' || m", "ada": "'Mod' || m", "go": "'x/mod' || m", "java": "'x.mod' || m", "csharp": "'X.Mod' || m", "kotlin": "'x.mod' || m", "php": "'X\\Mod' || m", "scala": "'x.mod' || m"}, "'mod' || m")
