"""Queries over the driver tables, with DuckDB SQL that gives the same rows from the corpus' parameters alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import globs, registry
from codeloom.operators import corpus, facts, lines
from codeloom.plans.code_corpus import CORPUS_SQL, IMPORT_SQL, case, code_corpus
from codeloom.sources.staging import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_MODE = "CASE language WHEN 'python' THEN 'Python' WHEN 'ada' THEN 'Ada' WHEN 'fortran' THEN 'Fortran' WHEN 'lua' THEN 'Lua' ELSE 'Default' END"
_P = "CASE WHEN language = 'python' OR language = 'fortran' THEN 1 ELSE 2 END"
_TABLE = "(VALUES " + ", ".join(f"({i}, '{x.name}', '{x.key}', '{' '.join(x.extensions)}', '{' '.join(x.explicit_only)}', '{x.sloc_mode}')" for i, x in enumerate(registry.LANGUAGES)) + ") AS l(ord, name, key, exts, extra, mode)"
#: Blocks and edges of ``main`` by language and body; ``helper`` is one return in C and C++, one value in Rust.
_CFG = {
    "c": ["1", "4", "5", "8", "5"],
    "rust": ["1", "4", "5", "8", "4"],
}
_EDGES = {  # (src, dst, kind) of each body
    "c": [[], [(0, 1, "true_branch"), (0, 2, "false_branch"), (1, 3, "fallthrough"), (2, 3, "fallthrough")], [(0, 1, "true_branch"), (1, 2, "return"), (0, 3, "false_branch"), (3, 4, "fallthrough")],
          [(0, 1, "fallthrough"), (1, 2, "false_branch"), (1, 3, "true_branch"), (3, 4, "true_branch"), (4, 2, "break"), (3, 6, "false_branch"), (6, 7, "fallthrough"), (7, 1, "back_edge")],
          [(0, 1, "fallthrough"), (1, 2, "false_branch"), (1, 3, "true_branch"), (3, 1, "continue")]],
    "rust": [[], [(0, 1, "true_branch"), (0, 2, "false_branch"), (1, 3, "fallthrough"), (2, 3, "fallthrough")], [(0, 1, "true_branch"), (1, 2, "return"), (0, 3, "false_branch"), (3, 4, "fallthrough")],
             [(0, 1, "fallthrough"), (1, 2, "false_branch"), (1, 3, "true_branch"), (3, 4, "true_branch"), (4, 2, "break"), (3, 6, "false_branch"), (6, 7, "fallthrough"), (7, 1, "back_edge")],
             [(0, 1, "fallthrough"), (1, 3, "return")]],
}
_EXITS = {"c": ["0", "3", "2,4", "", "4"], "rust": ["0", "3", "2,4", "", "3"]}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _with(sql: str) -> str:
    return "WITH " + CORPUS_SQL.strip() + "\n" + sql


def _facts(spark: SparkSession, sf_dir: str, *relations: str, languages: tuple[str, ...] = ()) -> DataFrame:
    """Facts of the corpus; a language filter applies before the parse.  Where several relations are asked for, one parse is written."""
    files = code_corpus(spark, sf_dir, spread=True)
    if languages:
        files = files.where(F.col("language").isin(*languages))
    f = facts.facts(files, relations)
    return written(f, "facts") if len(relations) > 1 else f


# ---- registry and globs


@_query(f"SELECT ord, name, key, replace(exts, ' ', ',') AS extensions, replace(extra, ' ', ',') AS explicit_only, mode AS sloc_mode FROM {_TABLE}")
def languages_table(spark, sf_dir):
    return registry.languages(spark).withColumns({"extensions": F.array_join("extensions", ","), "explicit_only": F.array_join("explicit_only", ",")})


@_query(f"SELECT -1 AS ord, 'Supported languages:' AS line UNION ALL SELECT ord, '  ' || rpad(name, 10, ' ') || '  .' || replace(exts, ' ', ' .') || CASE WHEN extra = '' THEN '' ELSE '  (also .' || replace(extra, ' ', ' .') || ' when passed explicitly)' END FROM {_TABLE}")
def language_report(spark, sf_dir):
    return registry.report_lines(spark)


@_query(_with(f"SELECT file_id, language, language AS grammar, {_MODE} AS sloc_mode FROM c"))
def lang_by_ext(spark, sf_dir):
    return code_corpus(spark, sf_dir).select("file_id", "language", "grammar", "sloc_mode")


@_query(
    _with("""SELECT file_id, CASE file_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'h' WHEN 2 THEN 'ads' WHEN 3 THEN 'tsx' WHEN 4 THEN 'txt' ELSE ext END AS ext,
  file_id % 6 IN (3, 5) AS is_source,
  file_id % 6 NOT IN (0, 4) AS is_parseable,
  CASE file_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'c' WHEN 2 THEN 'ada' WHEN 3 THEN 'tsx' WHEN 4 THEN NULL ELSE language END AS grammar,
  CASE file_id % 6 WHEN 1 THEN 'cpp' WHEN 0 THEN NULL WHEN 2 THEN 'ada' WHEN 3 THEN 'tsx' WHEN 4 THEN NULL ELSE language END AS header_grammar FROM c""")
)
def extension_lookups(spark, sf_dir):
    d = code_corpus(spark, sf_dir)
    k = F.col("file_id") % 6
    own = registry.extension_of(F.col("path"))
    path = F.concat(F.lit("a.b/"), F.when(k == 0, ".c").when(k == 1, "x.h").when(k == 2, "y.z.ads").when(k == 3, "q.tsx").when(k == 4, "n.txt").otherwise(F.concat(F.lit("f."), own)))
    d = d.select("file_id", path.alias("path"))
    ext = registry.extension_of(F.col("path"))
    return d.select("file_id", ext.alias("ext"), F.coalesce(registry.is_source_ext(ext), F.lit(False)).alias("is_source"), F.coalesce(registry.is_parseable_ext(ext), F.lit(False)).alias("is_parseable"), registry.grammar_of(F.col("path")).alias("grammar"), registry.grammar_of_header(F.col("path"), F.lit(True)).alias("header_grammar"))


@_query(_with("SELECT file_id, file_id % 7 = 0 OR ext IN ('py', 'js') OR file_id % 7 = 3 AND file_id % 10 = 1 AS ignored FROM c"))
def path_ignored(spark, sf_dir):
    return code_corpus(spark, sf_dir).select("file_id", globs.is_ignored(F.col("path"), ["vendor/**", "**/*.{py,js}", "src/d3/f*1.*"]).alias("ignored"))


# ---- lines


@_query(_with(f"SELECT file_id, 0 AS byte_start, 3 * {_P} + 32 AS byte_end, 1 AS line_start, 3 AS line_end, 'scans' AS tools, TRUE AS hits_scans, FALSE AS hits_sec FROM c WHERE head = 0"))
def ignored_regions(spark, sf_dir):
    r = lines.ignored_regions(code_corpus(spark, sf_dir))
    return r.select("file_id", "byte_start", "byte_end", "line_start", "line_end", F.array_join("tools", ",").alias("tools"), lines.region_applies_to(F.col("tools"), "SCANS").alias("hits_scans"), lines.region_applies_to(F.col("tools"), "sec").alias("hits_sec"))


@_query(_with("SELECT language, CAST(3 * count(*) AS BIGINT) AS ignored_lines, count(*) AS files FROM c WHERE head = 0 GROUP BY language"))
def ignored_lines_by_language(spark, sf_dir):
    c = code_corpus(spark, sf_dir)
    r = lines.ignored_regions(c).join(c.select("file_id", "language"), "file_id")
    return r.groupBy("language").agg(F.sum(F.col("line_end") - F.col("line_start") + 1).alias("ignored_lines"), F.count_distinct("file_id").alias("files"))


@_query(_with("SELECT file_id, 1 AS comment_line, 3 AS target_line, 'sec' AS tool, 'R' || m AS rule, 'h' || f AS hash, 'a, b' AS justification, m = 5 AS is_r5 FROM c WHERE head = 1"))
def suppressions(spark, sf_dir):
    s = lines.suppressions(code_corpus(spark, sf_dir))
    return s.withColumn("is_r5", lines.suppression_applies_to(F.col("tool"), F.col("rule"), "SEC", "R5"))


@_query("SELECT doc_id, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS line_bytes FROM (SELECT doc_id, unnest(CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END) AS line FROM documents) GROUP BY doc_id")
def line_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lines.line_table(d, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("line_bytes"))


# ---- imports and coupling


@_query(_with(f"SELECT file_id, 0 AS seq, {IMPORT_SQL} AS source FROM c"))
def import_edges(spark, sf_dir):
    return facts.imports(_facts(spark, sf_dir, "imports"))


@_query(_with("SELECT file_id, 1 AS imports FROM c"))
def distinct_imports(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    return facts.distinct_import_counts(files, _facts(spark, sf_dir, "imports"))


@_query(_with(f"SELECT {IMPORT_SQL} AS source, count(*) AS ca FROM c GROUP BY 1"))
def afferent_coupling(spark, sf_dir):
    return corpus.coupling(facts.imports(_facts(spark, sf_dir, "imports")))[1]


@_query(_with("SELECT file_id, CAST(1 AS BIGINT) AS ce FROM c"))
def efferent_coupling(spark, sf_dir):
    return corpus.coupling(facts.imports(_facts(spark, sf_dir, "imports")))[0]


# ---- calls


@_query(_with("SELECT file_id, 0 AS seq, 'main' || f AS caller, 'helper' || f AS callee, FALSE AS is_external FROM c WHERE language <> 'php' UNION ALL SELECT file_id, 1, 'main' || f, 'main' || g, f <> g FROM c WHERE language <> 'php'"))
def call_edges(spark, sf_dir):
    return facts.call_edges(_facts(spark, sf_dir, "calls"))


@_query(_with("SELECT language, count(*) AS external_calls FROM c WHERE language <> 'php' AND f <> g GROUP BY language"))
def external_calls(spark, sf_dir):
    languages = code_corpus(spark, sf_dir).select("file_id", "language")
    e = facts.call_edges(_facts(spark, sf_dir, "calls")).where("is_external")
    return e.join(languages, "file_id").groupBy("language").agg(F.count("*").alias("external_calls"))


@_query(_with("SELECT file_id, n FROM (SELECT file_id, unnest(['helper' || f, 'main' || f]) AS n FROM c)").replace("SELECT file_id, n FROM", "SELECT file_id, n AS name FROM"))
def local_names(spark, sf_dir):
    return facts.local_names(_facts(spark, sf_dir, "local_names"))


@_query(_with("SELECT file_id, 'main' || g AS callee, (SELECT count(*) FROM c AS o WHERE o.f = c.g) AS definitions FROM c WHERE language <> 'php' AND f <> g"))
def resolved_calls(spark, sf_dir):
    f = _facts(spark, sf_dir, "calls", "functions")
    return corpus.resolve_calls(facts.call_edges(f), facts.functions(f)).select("file_id", "callee", "definitions")


_EDGE_SQL = CORPUS_SQL.strip() + ", e AS (SELECT 'main' || f AS src, 'main' || g AS dst FROM c WHERE language <> 'php' UNION SELECT 'main' || f, 'helper' || f FROM c WHERE language <> 'php')"


def _call_graph(spark, sf_dir):
    """Calls as a graph of names; it is small whatever the corpus (names are numbers below 97), so it is written once."""
    return facts.call_edges(_facts(spark, sf_dir, "calls")).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


@_query("WITH RECURSIVE " + _EDGE_SQL + ", r AS (SELECT src AS s, dst AS n FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.n) SELECT s AS start, n AS node FROM r")
def call_graph_reach(spark, sf_dir):
    e = written(_call_graph(spark, sf_dir).distinct(), "calls")
    return corpus.reachable(e, e.select(F.col("src").alias("start")))


@_query("WITH RECURSIVE " + _EDGE_SQL + ", r AS (SELECT src AS s, dst AS n FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.n) SELECT s AS node FROM r WHERE s = n")
def call_cycles(spark, sf_dir):
    return corpus.cycles(_call_graph(spark, sf_dir))


# ---- control flow


def _by_body(values: dict[str, list[str]], quote: bool = False) -> str:
    q = lambda xs: "[" + ", ".join(f"'{x}'" if quote else x for x in xs) + "]"
    return f"CASE WHEN language = 'rust' THEN {q(values['rust'])}[b + 1] ELSE {q(values['c'])}[b + 1] END"


_C_LIKE = ("c", "cpp", "rust")
#: ``helper`` is one block in Rust; in C and C++ its return ends one and an empty one follows.
_HELPER_SQL = "SELECT file_id, 'helper' || f AS name, CAST(CASE WHEN language = 'rust' THEN 1 ELSE 2 END AS BIGINT) AS block_count, CASE WHEN language = 'rust' THEN '0' ELSE '1' END AS exits FROM c WHERE language IN ('c', 'cpp', 'rust')"


@_query(_with(f"SELECT file_id, 'main' || f AS name, CAST({_by_body(_CFG)} AS BIGINT) AS block_count, {_by_body(_EXITS, True)} AS exits FROM c WHERE language IN ('c', 'cpp', 'rust') UNION ALL {_HELPER_SQL}"))
def cfg_blocks_and_exits(spark, sf_dir):
    f = facts.cfg_functions(_facts(spark, sf_dir, "cfg_functions", languages=_C_LIKE))
    return f.select("file_id", "name", "block_count", F.array_join(F.transform("exits", lambda x: x.cast("string")), ",").alias("exits"))


@_query(
    _with(
        "SELECT file_id, 'main' || f AS name, src, dst, kind FROM c JOIN (VALUES "
        + ", ".join(f"({lang == 'rust'}, {b}, {s}, {d}, '{k}')" for lang, bodies in _EDGES.items() for b, es in enumerate(bodies) for s, d, k in es)
        + ") AS e(rust, body, src, dst, kind) ON e.rust = (language = 'rust') AND e.body = c.b WHERE language IN ('c', 'cpp', 'rust') UNION ALL SELECT file_id, 'helper' || f, 0, 1, 'return' FROM c WHERE language IN ('c', 'cpp')"
    )
)
def cfg_edges(spark, sf_dir):
    f = _facts(spark, sf_dir, "cfg_functions", "cfg_edges", languages=_C_LIKE)
    names = facts.cfg_functions(f).select("file_id", "func_id", "name")
    return facts.cfg_edges(f).join(names, ["file_id", "func_id"]).select("file_id", "name", "src", "dst", "kind")


@_query(_with(f"SELECT language, CAST(sum(CASE WHEN language = 'rust' THEN 1 ELSE 2 END + {_by_body(_CFG)}) AS BIGINT) AS blocks FROM c WHERE language IN ('c', 'cpp', 'rust') GROUP BY language"))
def cfg_block_totals(spark, sf_dir):
    b = facts.cfg_blocks(_facts(spark, sf_dir, "cfg_blocks", languages=("c", "cpp", "rust")))
    return b.join(code_corpus(spark, sf_dir).select("file_id", "language"), "file_id").groupBy("language").agg(F.count("*").alias("blocks"))


# ---- standards


@_query(_with("SELECT file_id, [NULL, 'C99', 'C11', 'C23'][r % 4 + 1] AS standard FROM c WHERE language = 'c'"))
def c_std_min(spark, sf_dir):
    return facts.min_c_standard(_facts(spark, sf_dir, "c_standard", languages=("c",)))


@_query(_with("SELECT file_id, language = 'cpp' AND r % 2 = 1 AS looks_like_cpp FROM c WHERE language IN ('c', 'cpp')"))
def header_is_cpp(spark, sf_dir):
    return facts.looks_like_cpp(_facts(spark, sf_dir, "cpp", languages=("c", "cpp")))


# ---- fingerprints


_ROLE = "CASE WHEN language IN ('c', 'cpp', 'rust') AND role = 'main' THEN b ELSE -1 END"


@_query(_with(f"SELECT language, role, {_ROLE} AS body, count(*) AS group_size FROM c, (VALUES ('main'), ('helper')) AS x(role) GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def fingerprint_groups(spark, sf_dir):
    c = code_corpus(spark, sf_dir).select("file_id", "language", "body_ix")
    fp = facts.function_fingerprints(_facts(spark, sf_dir, "fingerprints"), 3).join(c, "file_id")
    fp = fp.withColumn("hash", F.concat_ws(":", "language", "hash"))
    g = facts.duplicate_groups(fp)
    role = F.regexp_extract("name", "^[a-z]+", 0)
    body = F.when(F.col("language").isin("c", "cpp", "rust") & (role == "main"), F.col("body_ix")).otherwise(-1)
    return g.groupBy("hash", "language", role.alias("role"), body.alias("body"), "group_size").count().select("language", "role", F.col("body").cast("long").alias("body"), "group_size")


@_query("SELECT md5(text) AS hash, count(*) AS group_size, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("hash"))
    g = facts.duplicate_groups(d, "hash", ("doc_id",))
    return g.where("member_pos = 1").select("hash", "group_size", F.col("doc_id").alias("first_doc"))


# ---- trees


CALLS = ("call_expression", "call", "method_invocation", "invocation_expression", "function_call", "function_call_expression", "procedure_call_statement")
#: First call of a file, rows of it and of ``main`` after the head's lines, text after ``helper`` and its number.
_ROWS = {  # language: (row of the first call, row of main)
    "c": (4, 3), "cpp": (4, 3), "rust": (3, 2), "python": (5, 4), "javascript": (2, 2), "typescript": (2, 2), "ada": (7, 1), "go": (4, 3), "java": (3, 3), "csharp": (3, 3),
    "kotlin": (3, 2), "swift": (3, 2), "php": (3, 3), "fortran": (2, 0), "scala": (4, 3), "lua": (0, 2),
}
_HEAD = "CASE head WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END"
_FIRST = case("language", {k: str(v[0]) for k, v in _ROWS.items()}, "0")
_MAIN = case("language", {k: str(v[1]) for k, v in _ROWS.items()}, "0")
_STATIC = "language = 'c' AND r % 4 = 2"


def _nodes(spark, sf_dir, columns, kinds=None):
    """Nodes of the whole corpus, as far as a query needs them, parsed once and written."""
    return written(facts.nodes(code_corpus(spark, sf_dir, spread=True), kinds=kinds, columns=columns), "nodes")


def _functions(n: DataFrame) -> DataFrame:
    """Roots of functions: named nodes (keywords have the same kinds in some languages), without whole programs."""
    return n.where(facts.is_function_kind(F.col("kind")) & F.col("is_named") & (F.col("kind") != "program"))


_IF, _WHILE, _FOR = "b IN (1, 2, 3)", "b = 3", "b = 4"


@_query(
    _with(
        f"""SELECT language, what, CAST(sum(n) AS BIGINT) AS nodes FROM (
  SELECT language, unnest(['call', 'function', 'if', 'while', 'for']) AS what,
         unnest([2 + CASE WHEN {_STATIC} OR language = 'lua' THEN 1 ELSE 0 END, 2, CASE WHEN like_c AND {_IF} THEN 1 ELSE 0 END, CASE WHEN like_c AND {_WHILE} THEN 1 ELSE 0 END, CASE WHEN like_c AND {_FOR} THEN 1 ELSE 0 END]) AS n
  FROM (SELECT *, language IN ('c', 'cpp', 'rust') AS like_c FROM c)) GROUP BY 1, 2 HAVING sum(n) > 0"""
    )
)
def node_kind_counts(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    branches = {"if": ("if_statement", "if_expression"), "while": ("while_statement", "while_expression"), "for": ("for_statement", "loop_expression")}
    looked_for = {*CALLS, *facts.FUNCTION_KINDS, *(k for kinds in branches.values() for k in kinds)}
    n = facts.nodes(code_corpus(spark, sf_dir, spread=True), kinds=looked_for, columns=("kind", "is_named"))
    kind, named = F.col("kind"), F.col("is_named")
    what = F.when(kind.isin(*CALLS), "call").when(facts.is_function_kind(kind) & (kind != "program"), "function")
    for name, kinds in branches.items():
        what = what.when(kind.isin(*kinds), name)
    found = facts.find_descendants(n, pred=named & what.isNotNull()).select("file_id", what.alias("what"))
    return found.join(files.select("file_id", "language"), "file_id").groupBy("language", "what").agg(F.count("*").alias("nodes"))


@_query(_with(f"SELECT file_id, {_HEAD} + {_MAIN} AS function_row, 2 AS calls FROM c"))
def nearest_function(spark, sf_dir):
    n = _nodes(spark, sf_dir, ("node_id", "last_desc", "kind", "is_named", "start_row"), {*CALLS, *facts.FUNCTION_KINDS})
    roots = _functions(n)
    near = facts.find_ancestor(n, n.where(F.col("kind").isin(*CALLS)), pred=facts.is_function_kind(F.col("kind")) & F.col("is_named") & (F.col("kind") != "program"))
    rows = roots.select("file_id", F.col("node_id").alias("ancestor_id"), F.col("start_row").alias("function_row"))
    return near.join(rows, ["file_id", "ancestor_id"]).groupBy("file_id", "function_row").agg(F.count("*").alias("calls"))


@_query(_with(f"""SELECT file_id, CASE WHEN {_STATIC} THEN '_Static_assert(1, "x")' WHEN language = 'lua' THEN 'require("mod' || m || '")' WHEN language = 'ada' THEN 'helper' || f || ';' WHEN language = 'php' THEN 'helper' || f || '($x)' ELSE 'helper' || f || '(x)' END AS first_call,
  {_HEAD} + CASE WHEN {_STATIC} THEN 1 ELSE {_FIRST} END AS call_row FROM c"""))
def first_descendant(spark, sf_dir):
    n = _nodes(spark, sf_dir, ("node_id", "last_desc", "kind", "start_byte", "end_byte", "start_row"), CALLS)
    roots = n.where("node_id = 0").select("file_id", "node_id", "last_desc")
    first = facts.find_first_descendant(n, kinds=CALLS, roots=roots)
    return facts.node_text(first, code_corpus(spark, sf_dir)).select("file_id", F.col("node_text").alias("first_call"), F.col("start_row").alias("call_row"))


@_query(_with("SELECT file_id, 2 AS functions, 2 AS agreeing FROM c"))
def structural_hash_in_sql(spark, sf_dir):
    files = code_corpus(spark, sf_dir, spread=True)
    n = _nodes(spark, sf_dir, ("node_id", "parent_id", "last_desc", "child_count", "kind", "is_named", "field", "start_byte", "text"))
    roots = _functions(n).select("file_id", "node_id", "last_desc", "start_byte")
    h = facts.structural_hashes(n, roots).join(roots.select("file_id", F.col("node_id").alias("root_id"), "start_byte"), ["file_id", "root_id"])
    fp = facts.function_fingerprints(facts.facts(files, ("fingerprints",)), 0).select("file_id", "start_byte", F.col("hash").alias("own"))
    return h.join(fp, ["file_id", "start_byte"]).groupBy("file_id").agg(F.count("*").alias("functions"), F.sum((F.col("hash") == F.col("own")).cast("long")).alias("agreeing"))


# ---- pages


@_query(r"SELECT page_id, regexp_extract(html, 'track\((\d+)\)', 1) AS tracked FROM pages")
def page_calls(spark, sf_dir):
    """The one call in each page's script, through the JavaScript parser."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1).alias("source"), F.lit("javascript").alias("grammar"))
    n = facts.nodes(p, "page_id")
    calls = n.where("kind = 'call_expression'").select("page_id", F.col("node_id").alias("call_id"), "last_desc")
    arg = n.where("kind = 'number'").select(F.col("page_id").alias("p"), "node_id", "text")
    return calls.join(arg, (F.col("page_id") == F.col("p")) & (F.col("node_id") > F.col("call_id")) & (F.col("node_id") <= F.col("last_desc"))).select("page_id", F.col("text").alias("tracked"))
