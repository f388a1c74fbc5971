"""Parse once, ask often: every per-file relation from one pass over the files.

``facts`` parses each file in an Arrow batch and emits all asked-for relations
in one narrow layout; the functions below are projections of it, so a corpus is
parsed once, written, and queried as tables.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.staging import written
from codeloom.syntax import GRAMMARS, parse
from codeloom.syntax.analysis import FUNCTION_KINDS, Cfg, Tree, function_cfg
from codeloom.syntax.tree import FIELDS, flatten

RELATIONS = ("imports", "calls", "local_names", "functions", "fingerprints", "c_standard", "cpp", "cfg_blocks", "cfg_stmts", "cfg_edges", "cfg_functions")
_LAYOUT = "key string, relation string, seq long, a string, b string, c string, flag boolean, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long"
_NAMES = [x.split()[0] for x in _LAYOUT.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _LAYOUT.split(", ")]


def _offsets(source: str):
    """Characters to bytes; rows from 0."""
    if source.isascii():
        return lambda i: i
    # only the characters that are not ASCII move what follows them
    wide = [(i, len(ch.encode("utf-8", "surrogatepass")) - 1) for i, ch in enumerate(source) if ch > "\x7f"]
    at, extra, total = [i for i, _ in wide], [0], 0
    for _, n in wide:
        total += n
        extra.append(total)
    return lambda i: i + extra[bisect_left(at, i)]


def file_facts(grammar: str, source: str, relations=RELATIONS):
    """Rows (relation, seq, a, b, c, flag, n1 ... n6) of one file."""
    tree = Tree(parse(grammar, source), source, grammar)
    byte = _offsets(source)
    breaks = [i for i, ch in enumerate(source) if ch == "\n"]
    line = lambda i: bisect_left(breaks, i) + 1
    want = set(relations)
    if "imports" in want:
        for i, s in enumerate(tree.imports()):
            yield "imports", i, s, None, None, None
    if "calls" in want:
        for i, (caller, callee, external) in enumerate(tree.call_edges()):
            yield "calls", i, caller, callee, None, external
    if "local_names" in want:
        for i, s in enumerate(sorted(tree.local_names())):
            yield "local_names", i, s, None, None, None
    if want & {"functions", "fingerprints", "cfg_blocks", "cfg_stmts", "cfg_edges", "cfg_functions"}:
        for i, (f, name) in enumerate(tree.functions()):
            if "functions" in want:
                yield "functions", i, name, f.kind, None, tree.is_macro_like(f), byte(f.start), byte(f.end), line(f.start), line(f.end)
            if "fingerprints" in want:
                h, n = tree.structural_hash(f)
                yield "fingerprints", i, name, f.kind, h, f.named, n, byte(f.start), byte(f.end), line(f.start), line(f.end)
            if want & {"cfg_blocks", "cfg_stmts", "cfg_edges", "cfg_functions"} and (g := function_cfg(grammar, f)) is not None:
                yield from _cfg_rows(g, i, name, byte, want)
    if "c_standard" in want and grammar == "c":
        yield "c_standard", 0, tree.min_c_standard(), None, None, None
    if "cpp" in want:
        is_cpp = tree if grammar == "cpp" else Tree(parse("cpp", source), source, "cpp") if grammar == "c" else None
        if is_cpp is not None:
            yield "cpp", 0, None, None, None, is_cpp.looks_like_cpp()


def _cfg_rows(g: Cfg, func: int, name: str | None, byte, want: set[str]):
    if "cfg_functions" in want:
        yield "cfg_functions", 0, name, ",".join(map(str, g.exits)), None, None, func, len(g.span), 0
    if "cfg_blocks" in want:
        for b, (s, e) in enumerate(g.span):
            c = g.condition[b]
            yield "cfg_blocks", b, None, None, None, None, func, b, byte(s), byte(e), byte(c[0]) if c else None, byte(c[1]) if c else None
    if "cfg_stmts" in want:
        for b, spans in enumerate(g.statements):
            for p, (s, e) in enumerate(spans):
                yield "cfg_stmts", p, None, None, None, None, func, b, byte(s), byte(e)
    if "cfg_edges" in want:
        for k, (a, b, kind) in enumerate(g.edges):
            yield "cfg_edges", k, kind, None, None, None, func, a, b


def _parseable(files: DataFrame, key: str, source: str, grammar: str, strict: bool) -> DataFrame:
    """Only what the parser needs leaves the JVM; files without a grammar don't."""
    f = files.select(F.col(key).cast("string").alias("key"), F.col(source).cast("string").alias("source"), F.col(grammar).alias("grammar"))
    known = F.col("grammar").isin(sorted(GRAMMARS))
    if strict:
        return f.withColumn("grammar", F.when(known, F.col("grammar")).otherwise(F.raise_error(F.concat(F.lit("unknown language key: "), F.coalesce("grammar", F.lit("NULL")))).cast("string")))
    return f.where(known & F.col("source").isNotNull())


def facts(files: DataFrame, relations=RELATIONS, key: str = "file_id", source: str = "source", grammar: str = "grammar", strict: bool = False) -> DataFrame:
    """One row a fact. An unknown or NULL grammar gives no rows, or an error if ``strict``."""
    relations = tuple(relations)

    def run(batches):
        for batch in batches:
            rows = []
            for k, s, g in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for r in file_facts(g, s, relations):
                    rows.append((k, *r, *([None] * (12 - len(r)))))
                if len(rows) >= 20_000:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)

    return _parseable(files, key, source, grammar, strict).mapInArrow(run, _LAYOUT).withColumnRenamed("key", key).withColumn(key, F.col(key).cast(files.schema[key].dataType))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _pick(facts_: DataFrame, relation: str, key: str, **columns: str | Column) -> DataFrame:
    return facts_.where(F.col("relation") == relation).select(key, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def imports(f: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, seq, source``: in reading order, repeats kept."""
    return _pick(f, "imports", key, seq="seq", source="a")


def distinct_import_counts(files: DataFrame, f: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, imports``: every file, 0 where it imports nothing."""
    n = imports(f, key).groupBy(key).agg(F.count_distinct("source").alias("imports"))
    return files.select(key).join(n, key, "left").select(key, F.coalesce("imports", F.lit(0)).cast("long").alias("imports"))


def call_edges(f: DataFrame, key: str = "file_id") -> DataFrame:
    return _pick(f, "calls", key, seq="seq", caller="a", callee="b", is_external="flag")


def local_names(f: DataFrame, key: str = "file_id") -> DataFrame:
    return _pick(f, "local_names", key, name="a")


def functions(f: DataFrame, key: str = "file_id") -> DataFrame:
    return _pick(f, "functions", key, func_id="seq", name="a", kind="b", is_macro_like="flag", start_byte="n1", end_byte="n2", start_line="n3", end_line="n4")


def function_fingerprints(f: DataFrame, min_nodes: int, key: str = "file_id", strict_parity: bool = False) -> DataFrame:
    """Functions of at least ``min_nodes`` nodes. Keyword tokens and roots whose kind is that of a function only with ``strict_parity``."""
    out = _pick(f, "fingerprints", key, func_id="seq", name="a", kind="b", hash="c", named="flag", node_count="n1", start_byte="n2", end_byte="n3", start_line="n4", end_line="n5").where(F.col("node_count") >= min_nodes)
    if not strict_parity:
        out = out.where(F.col("named") & ~((F.col("kind") == "program") & F.col("name").isNull()))
    return out.drop("named")


def duplicate_groups(fingerprints: DataFrame, hash_col: str = "hash", order_by: tuple[str, ...] = ("file_id", "start_byte")) -> DataFrame:
    """Rows whose hash occurs twice or more, with ``group_size`` and ``member_pos``.

    Sizes come from a pre-aggregated count, and positions from ranges of
    (hash, order): a hash that a third of all rows share is cut into many
    ranges, each counts its own rows, and only the ranges' counts are summed up
    by hash.  The input is read once for the sizes and once, written, for the
    ranges.
    """
    mark = "_"
    while any(c.lower().startswith(mark) for c in fingerprints.columns):
        mark += "_"
    h, r, at, first, n, before = (f"{mark}{x}" for x in ("hash", "range", "at", "first", "n", "before"))
    fingerprints = written(fingerprints, "fingerprints")
    sizes = fingerprints.groupBy(hash_col).agg(F.count("*").alias("group_size")).where("group_size > 1")
    members = fingerprints.join(sizes, hash_col)
    ranges = members.repartitionByRange(hash_col, *order_by).sortWithinPartitions(hash_col, *order_by)
    ranges = written(ranges.withColumns({r: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ranges")
    counts = ranges.groupBy(F.col(hash_col).alias(h), F.col(r).alias(f"{r}2")).agg(F.min(at).alias(first), F.count("*").alias(n))
    earlier = F.coalesce(F.sum(n).over(Window.partitionBy(h).orderBy(f"{r}2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.join(counts.withColumn(before, earlier), (F.col(hash_col) == F.col(h)) & (F.col(r) == F.col(f"{r}2")))
    return placed.withColumn("member_pos", F.col(before) + F.col(at) - F.col(first) + 1).drop(h, r, f"{r}2", at, first, n, before)


def min_c_standard(f: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, standard`` of every C file; NULL without a marker."""
    return _pick(f, "c_standard", key, standard="a")


def looks_like_cpp(f: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, looks_like_cpp`` of C and C++ files, read as C++."""
    return _pick(f, "cpp", key, looks_like_cpp="flag")


def cfg_functions(f: DataFrame, key: str = "file_id") -> DataFrame:
    exits = F.filter(F.transform(F.split("b", ","), lambda x: F.try_to_number(x, F.lit("999999999999")).cast("long")), lambda x: x.isNotNull())
    return _pick(f, "cfg_functions", key, func_id="n1", name="a", block_count="n2", entry="n3", exits=exits)


def cfg_blocks(f: DataFrame, key: str = "file_id") -> DataFrame:
    return _pick(f, "cfg_blocks", key, func_id="n1", block_id="n2", byte_start="n3", byte_end="n4", cond_start="n5", cond_end="n6")


def cfg_stmts(f: DataFrame, key: str = "file_id") -> DataFrame:
    return _pick(f, "cfg_stmts", key, func_id="n1", block_id="n2", pos="seq", byte_start="n3", byte_end="n4")


def cfg_edges(f: DataFrame, key: str = "file_id") -> DataFrame:
    return _pick(f, "cfg_edges", key, func_id="n1", seq="seq", src="n2", dst="n3", kind="a")


def get_block(blocks: DataFrame, block_id: int) -> DataFrame:
    """Of :func:`cfg_blocks`, that block of every graph which has one."""
    return blocks.where(F.col("block_id") == block_id)


def successors(edges: DataFrame, block_id: int) -> DataFrame:
    return edges.where(F.col("src") == block_id)


def predecessors(edges: DataFrame, block_id: int) -> DataFrame:
    return edges.where(F.col("dst") == block_id)


def is_function_kind(kind: Column) -> Column:
    return kind.isin(sorted(FUNCTION_KINDS))


# ---- trees as tables

_NODE = "key string, grammar string, node_id long, parent_id long, last_desc long, depth long, child_index long, child_count long, named_index long, kind string, is_named boolean, field string, start_byte long, end_byte long, start_row long, end_row long, text string, has_error boolean"
_NODE_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _NODE.split(", ")]


def nodes(files: DataFrame, key: str = "file_id", source: str = "source", grammar: str = "grammar", strict: bool = False, kinds=None, columns=None) -> DataFrame:
    """The syntax-node table: ``node_id`` in pre-order, ``last_desc`` the last node of the subtree.

    What a query has no use for need not leave the parser: with ``kinds`` only
    nodes of these kinds and each file's root come out, numbered as in the whole
    tree, with ``columns`` only those besides the key.
    """
    wanted = [n for n in FIELDS if columns is None or n in columns]
    extra = ["grammar"] if columns is None or "grammar" in columns else []
    if columns is not None and (unknown := set(columns) - {"grammar", *FIELDS}):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    keep = None if kinds is None else frozenset(kinds)
    at = [(FIELDS.index(n), _NODE_TYPES[FIELDS.index(n) + 2]) for n in wanted]
    kind = FIELDS.index("kind")

    def table(keys: list, grammars: list, rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(keys, pa.string()), *([pa.array(grammars, pa.string())] if extra else [])]
        return pa.record_batch(arrays + [pa.array([r[i] for r in rows], t) for i, t in at], names=["key", *extra, *wanted])

    def run(batches):
        for batch in batches:
            keys, grammars, rows = [], [], []
            for k, s, g in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = flatten(parse(g, s), s)
                if keep is not None:
                    found = [r for r in found if r[kind] in keep or not r[0]]
                for i in range(0, len(found), 20_000):
                    part = found[i : i + 20_000]
                    keys += [k] * len(part)
                    grammars += [g] * len(part)
                    rows += part
                    if len(rows) >= 20_000:
                        yield table(keys, grammars, rows)
                        keys, grammars, rows = [], [], []
            if rows:
                yield table(keys, grammars, rows)

    layout = ", ".join(x for x in _NODE.split(", ") if x.split()[0] in ("key", *extra, *wanted))
    return _parseable(files, key, source, grammar, strict).mapInArrow(run, layout).withColumnRenamed("key", key).withColumn(key, F.col(key).cast(files.schema[key].dataType))


def _kinds(pred: Column | None, kinds) -> Column:
    if pred is not None:
        return pred
    return F.col("kind").isin([kinds] if isinstance(kinds, str) else list(kinds))


def find_descendants(nodes_: DataFrame, pred: Column | None = None, kinds=(), roots: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """Nodes that match, in ``node_id`` order the reading order; with ``roots`` (``key, node_id, last_desc``) those at or below each, with its ``root_id``."""
    found = nodes_.where(_kinds(pred, kinds))
    if roots is None:
        return found
    r = roots.select(F.col(key).alias("r_key"), F.col("node_id").alias("root_id"), F.col("last_desc").alias("root_last"))
    return found.join(r, (F.col(key) == F.col("r_key")) & (F.col("node_id") >= F.col("root_id")) & (F.col("node_id") <= F.col("root_last"))).drop("r_key", "root_last")


def find_first_descendant(nodes_: DataFrame, pred: Column | None = None, kinds=(), roots: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """The first match of each file, or of each root."""
    found = find_descendants(nodes_, pred, kinds, roots, key)
    by = [key] if roots is None else [key, "root_id"]
    rest = [c for c in found.columns if c not in by]
    return found.groupBy(*by).agg(F.min_by(F.struct(*rest), "node_id").alias("x")).select(*by, "x.*")


def find_ancestor(nodes_: DataFrame, targets: DataFrame, pred: Column | None = None, kinds=(), key: str = "file_id") -> DataFrame:
    """``key, node_id, ancestor_id, ancestor_kind``: the nearest matching node around each target (never itself); targets without one are absent."""
    a = nodes_.where(_kinds(pred, kinds)).select(F.col(key).alias("a_key"), F.col("node_id").alias("ancestor_id"), F.col("last_desc").alias("a_last"), F.col("kind").alias("ancestor_kind"))
    t = targets.select(key, "node_id")
    near = t.join(a, (F.col(key) == F.col("a_key")) & (F.col("ancestor_id") < F.col("node_id")) & (F.col("node_id") <= F.col("a_last")))
    return near.groupBy(key, "node_id").agg(F.max("ancestor_id").alias("ancestor_id"), F.max_by("ancestor_kind", "ancestor_id").alias("ancestor_kind"))


def node_text(nodes_: DataFrame, files: DataFrame, key: str = "file_id", source: str = "source") -> DataFrame:
    """``nodes_`` with ``node_text``: the bytes of the span, '' where they are not UTF-8."""
    f = files.select(key, F.encode(F.col(source).cast("string"), "UTF-8").alias("bytes"))
    part = F.substring(F.col("bytes"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return nodes_.join(f, key).withColumn("node_text", F.when(F.is_valid_utf8(part), F.decode(part, "UTF-8")).otherwise("")).drop("bytes")


def structural_hashes(nodes_: DataFrame, roots: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, root_id, hash, node_count`` of any subtrees, in SQL over the node table: kinds and child counts in pre-order, then the declared type."""
    part = find_descendants(nodes_, F.lit(True), roots=roots, key=key)
    typed = F.when((F.col("parent_id") == F.col("root_id")) & F.col("field").isin("return_type", "result", "type"), F.struct(F.when(F.col("field") == "return_type", 0).when(F.col("field") == "result", 1).otherwise(2).alias("rank"), F.col("node_id").alias("at"), F.col("text").alias("text")))
    seq = F.array_sort(F.collect_list(F.struct("node_id", F.concat_ws("/", "kind", F.col("child_count").cast("string")).alias("k"))))
    g = part.groupBy(key, "root_id").agg(seq.alias("s"), F.min(typed).alias("t"), F.count("*").alias("node_count"))
    body = F.array_join(F.transform("s", lambda x: x["k"]), ";")
    return g.select(key, "root_id", F.md5(F.concat(body, F.coalesce(F.concat(F.lit("|"), F.col("t.text")), F.lit("")))).alias("hash"), "node_count")
