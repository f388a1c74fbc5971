"""The operators as SQL table functions: ``SELECT * FROM call_edges('c', source)``, or LATERAL over a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def _facts(relation: str, key: str, source: str):
    from codeloom.operators.facts import file_facts

    return file_facts(key, source or "", (relation,))


@udtf(returnType="seq long, caller string, callee string, is_external boolean")
class CallEdges:
    def eval(self, key: str, source: str):
        for r in _facts("calls", key, source):
            yield r[1], r[2], r[3], r[5]


@udtf(returnType="seq long, source string")
class ImportSources:
    def eval(self, key: str, source: str):
        for r in _facts("imports", key, source):
            yield r[1], r[2]


@udtf(returnType="func_id long, name string, kind string, hash string, node_count long, start_byte long, end_byte long, start_line long, end_line long")
class FunctionFingerprints:
    def eval(self, key: str, source: str, min_nodes: int):
        for r in _facts("fingerprints", key, source):
            if r[6] >= min_nodes and r[5]:
                yield r[1], r[2], r[3], r[4], *r[6:11]


def _cfg(key: str, source: str, name: str):
    """The first function of that name for which there is a graph."""
    from codeloom.syntax import parse
    from codeloom.syntax.analysis import Tree, function_cfg

    tree = Tree(parse(key, source or ""), source or "", key)
    return next((g for f, n in tree.functions() if n == name and (g := function_cfg(key, f)) is not None), None)


@udtf(returnType="src long, dst long, kind string")
class FunctionCfgEdges:
    def eval(self, key: str, source: str, name: str):
        g = _cfg(key, source, name)
        yield from g.edges if g else ()


@udtf(returnType="block_id long, statements long, is_exit boolean")
class FunctionCfgBlocks:
    def eval(self, key: str, source: str, name: str):
        g = _cfg(key, source, name)
        for b in range(len(g.span) if g else 0):
            yield b, len(g.statements[b]), b in g.exits


@udtf(returnType="standard string")
class MinCStandard:
    def eval(self, source: str):
        for r in _facts("c_standard", "c", source):
            yield (r[2],)


@udtf(returnType="looks_like_cpp boolean")
class LooksLikeCpp:
    def eval(self, source: str):
        for r in _facts("cpp", "cpp", source):
            yield (r[5],)


def _mode(key: str) -> str:
    from codeloom.functions.registry import LANGUAGES

    mode = next((x.sloc_mode for x in LANGUAGES if x.key == key), None)
    if mode is None:
        raise ValueError(f"unknown language key: {key}")
    return mode


@udtf(returnType="byte_start long, byte_end long, line_start long, line_end long, tools array<string>")
class IgnoredRegions:
    def eval(self, key: str, source: str):
        from codeloom.functions.markers import regions

        yield from regions(source or "", _mode(key))


@udtf(returnType="comment_line long, target_line long, tool string, rule string, hash string, justification string")
class Suppressions:
    def eval(self, key: str, source: str):
        from codeloom.functions.markers import suppressions

        yield from suppressions(source or "", _mode(key))


@udtf(returnType="ord int, name string, key string, extensions array<string>, explicit_only array<string>")
class Languages:
    def eval(self):
        from codeloom.functions.registry import LANGUAGES

        for i, x in enumerate(LANGUAGES):
            yield i, x.name, x.key, list(x.extensions), list(x.explicit_only)


TABLE_FUNCTIONS = {
    "ignored_regions": IgnoredRegions,
    "suppressions": Suppressions,
    "languages": Languages,
    "call_edges": CallEdges,
    "import_sources": ImportSources,
    "function_fingerprints": FunctionFingerprints,
    "function_cfg_edges": FunctionCfgEdges,
    "function_cfg_blocks": FunctionCfgBlocks,
    "min_c_standard": MinCStandard,
    "looks_like_cpp": LooksLikeCpp,
}


def register(spark: SparkSession) -> None:
    """An unknown language key raises ValueError in these, as for a single file."""
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
