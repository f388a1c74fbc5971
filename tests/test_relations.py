import pytest
from pyspark.sql import functions as F

from codeloom.functions import sqlfuncs
from codeloom.operators import corpus, facts
from codeloom.sources import files as sources
from codeloom.streaming import files as streaming


def corpus_of(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_id long, grammar string, source string")


def test_relations_from_one_parse(spark):
    f = facts.facts(corpus_of(spark, ("c", '#include "é.h"\nint f(int a) { if (a) { return g(a); } return 0; }\n'), ("zzz", "x"), (None, "y"), ("rust", None)))
    f.persist()
    assert [tuple(r) for r in facts.imports(f).collect()] == [(0, 0, "é.h")]
    assert [tuple(r) for r in facts.call_edges(f).collect()] == [(0, 0, "f", "g", True)]
    g = facts.cfg_functions(f).first()
    assert (g["block_count"], g["exits"]) == (6, [2, 5]) and facts.cfg_blocks(f).count() == 6
    e = facts.cfg_edges(f)
    assert {r["kind"] for r in facts.successors(e, 0).collect()} == {"true_branch", "false_branch"}
    assert [r["src"] for r in facts.predecessors(e, 2).collect()] == [1]
    fp = facts.function_fingerprints(f, 0).first()
    assert fp["start_byte"] == 16 and fp["start_line"] == 2
    assert facts.function_fingerprints(f, 10_000).count() == 0


def test_strict_mode_raises(spark):
    with pytest.raises(Exception, match="unknown language key"):
        facts.facts(corpus_of(spark, ("zzz", "x")), strict=True).collect()


def test_empty_table(spark):
    assert facts.facts(corpus_of(spark, ("c", "int x;")).where("false")).count() == 0


def test_duplicate_groups(spark):
    f = facts.facts(corpus_of(spark, ("c", "int f(int a) { return a; }"), ("c", "int g(int b) { return b; }"), ("c", "void h(void) { }")), ("fingerprints",))
    g = facts.duplicate_groups(facts.function_fingerprints(f, 1)).orderBy("member_pos").collect()
    assert [(r["file_id"], r["name"], r["group_size"], r["member_pos"]) for r in g] == [(0, "f", 2, 1), (1, "g", 2, 2)]


def test_positions_in_a_hot_group(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 700).cast("string"))).alias("hash"), ((F.col("id") * 7919) % 3001).alias("file_id"))
    got = facts.duplicate_groups(d.repartition(6), order_by=("file_id",)).collect()
    by = {}
    for r in got:
        by.setdefault(r["hash"], []).append((r["file_id"], r["member_pos"], r["group_size"]))
    assert len(by["hot"]) == 1000
    for rows in by.values():
        assert [p for _, p, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and {n for *_, n in rows} == {len(rows)}


def test_tree_search(spark):
    files = corpus_of(spark, ("c", "int f(int a) { while (a) { for (;;) { g(h(é)); } } return a; }"))
    n = facts.nodes(files).persist()
    assert facts.find_descendants(n, kinds="call_expression").count() == 2
    assert facts.find_descendants(n, kinds=("while_statement", "for_statement")).count() == 2
    assert facts.node_text(facts.find_descendants(n, kinds="return_statement"), files).first()["node_text"] == "return a;"
    loops = facts.find_ancestor(n, n.where("kind = 'call_expression'"), kinds=("while_statement", "for_statement"))
    assert {r["ancestor_kind"] for r in loops.collect()} == {"for_statement"}
    assert facts.find_ancestor(n, n.where("node_id = 0"), kinds="function_definition").count() == 0
    roots = n.where("kind = 'for_statement'").select("file_id", "node_id", "last_desc")
    assert facts.find_descendants(n, F.lit(True), roots=roots).where("kind = 'while_statement'").count() == 0
    assert facts.find_first_descendant(n, kinds="call_expression", roots=roots).first()["text"] is None


def test_closure_and_coupling(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {r["node"] for r in corpus.reachable(e, spark.createDataFrame([("b",)], "start string")).collect()} == {"a", "b", "c", "d"}
    assert {r["node"] for r in corpus.cycles(e).collect()} == {"a", "b", "c"}
    ce, ca = corpus.coupling(spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "file_id long, source string"))
    assert {tuple(r) for r in ce.collect()} == {(1, 1), (2, 1)} and ca.first()["ca"] == 2


def test_table_functions(spark):
    sqlfuncs.register(spark)
    assert spark.sql("SELECT callee FROM call_edges('c', 'void f() { g(); }')").collect()[0][0] == "g"
    assert spark.sql("SELECT source FROM import_sources('python', 'import a')").collect()[0][0] == "a"
    assert spark.sql("SELECT count(*) FROM function_cfg_edges('c', 'void f() { if (a) { b(); } }', 'f')").collect()[0][0] == 4
    assert spark.sql("SELECT looks_like_cpp FROM looks_like_cpp('class A {};')").collect()[0][0] is True
    with pytest.raises(Exception, match="unknown language key"):
        spark.sql("SELECT * FROM call_edges('zzz', '')").collect()


def test_read_tree_and_write(spark, tmp_path):
    (tmp_path / "src/vendor").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("import b\n")
    (tmp_path / "src/vendor/c.py").write_text("import d\n")
    (tmp_path / "src/x.h").write_bytes(b"int \xff;")
    files = sources.read_tree(spark, str(tmp_path / "src"), ignore=["**/vendor/**"])
    assert [r["language"] for r in files.collect()] == ["python"]
    assert sources.read_tree(spark, str(tmp_path / "src"), explicit=True).count() == 3
    f = facts.facts(files)
    sources.write_by(f, str(tmp_path / "facts"), "relation")
    back = spark.read.parquet(str(tmp_path / "facts"))
    assert [r["source"] for r in facts.imports(back).collect()] == ["b"]


def test_streaming(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, f"f{i}.c", "int f(int a) { return a; }")], "file_id long, path string, source string").write.mode("append").parquet(str(tmp_path / "in"))
    files = streaming.read_stream(spark, str(tmp_path / "in"))
    fp = facts.function_fingerprints(streaming.stream_facts(files, ("fingerprints",)), 1)
    q = streaming.duplicate_counts(fp).writeStream.outputMode("complete").format("memory").queryName("dups").start()
    q.processAllAvailable()
    q.stop()
    assert [r["group_size"] for r in spark.sql("SELECT * FROM dups").collect()] == [2]


GRAPHS = [
    [],
    [("a", "a"), ("b", None), (None, "c")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "a"), ("f", "g")],
    [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "b"), ("p", "q"), ("q", "p"), ("a", "p"), ("a", "b")],
    [(f"n{i}", f"n{(7 * i + 1) % 23}") for i in range(23)] + [(f"m{i}", f"m{i + 1}") for i in range(6)],
]


@pytest.mark.parametrize("graph", GRAPHS)
@pytest.mark.parametrize("most", [corpus.TASK_EDGES, 0])
def test_graphs_in_one_task_and_by_joins(spark, monkeypatch, graph, most):
    monkeypatch.setattr(corpus, "TASK_EDGES", most)
    to = {}
    for a, b in graph:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    reach = {}
    for s in to:
        seen, todo = set(), [s]
        while todo:
            for n in to.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[s] = seen
    e = spark.createDataFrame(graph, "src string, dst string")
    assert sorted(r["node"] for r in corpus.cycles(e).collect()) == sorted(s for s in reach if s in reach[s])
    got = corpus.reachable(e, e.select(F.col("src").alias("start"))).collect()
    assert sorted((r["start"], r["node"]) for r in got) == sorted((s, n) for s, ns in reach.items() for n in ns)
    few = corpus.reachable(e, e.select(F.col("src").alias("start")), max_rounds=0).collect()
    assert {(r["start"], r["node"]) for r in few} == {(s, n) for s, ns in to.items() for n in ns}


def test_lines_and_bytes_of_long_files():
    source = "".join(f"/* é世 */ int f{i}(int a)\n{{ return a; }}\n" for i in range(3000))
    from codeloom.operators.facts import file_facts

    rows = [r for r in file_facts("c", source, ("functions",)) if r[2]]
    assert len(rows) == 3000
    data = source.encode()
    for r in rows[::500] + rows[-1:]:
        start, end, first, last = r[6:10]
        assert data[start:end].decode().startswith(f"int {r[2]}(") and data[start:end].endswith(b"}")
        assert first == data.count(b"\n", 0, start) + 1 and last == data.count(b"\n", 0, end) + 1
