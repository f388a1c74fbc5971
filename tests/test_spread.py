"""That a parse has many tasks, however few bytes the ids of its files take, and that only what a query looks at leaves it."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import facts
from codeloom.plans import catalogue
from codeloom.plans import code_corpus as plan
from codeloom.plans.code_corpus import code_corpus


def corpus_of_ids(spark, path, n: int) -> str:
    spark.range(n).toDF("doc_id").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_files_are_spread_however_small_their_ids(spark, tmp_path):
    n = 20 * plan.TASK_FILES
    tasks = code_corpus(spark, corpus_of_ids(spark, tmp_path, n), spread=True).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 20 and sum(r["count"] for r in tasks) == n and max(r["count"] for r in tasks) < 1.5 * plan.TASK_FILES


def test_few_files_and_none_are_spread(spark, tmp_path):
    assert code_corpus(spark, corpus_of_ids(spark, tmp_path / "few", 3), spread=True).count() == 3
    assert code_corpus(spark, corpus_of_ids(spark, tmp_path / "none", 0), spread=True).count() == 0


SOURCES = [("c", "int f(int a) { return g(h(é)); }\n"), ("java", "class A { void b() { c(); } }"), ("c", ""), ("lua", "x = 1")]


def test_only_asked_for_nodes_leave_the_parser(spark):
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(SOURCES)], "file_id long, grammar string, source string")
    whole = facts.nodes(files)
    part = facts.nodes(files, kinds=("call_expression", "method_invocation"), columns=("kind", "node_id", "last_desc"))
    assert part.columns == ["file_id", "node_id", "last_desc", "kind"]
    want = whole.where("kind in ('call_expression', 'method_invocation') or node_id = 0").select(part.columns)
    got = sorted(part.collect())
    assert got == sorted(want.collect()) and len(got) == len(SOURCES) + 3
    assert sorted(facts.nodes(files, columns=("grammar",)).collect()) == sorted(whole.select("file_id", "grammar").collect())
    with pytest.raises(ValueError, match="unknown columns"):
        facts.nodes(files, columns=("kinds",))


@pytest.mark.parametrize("name, a_file", [("nearest_function", 8), ("first_descendant", 8)])
def test_tree_queries_write_no_nodes_that_they_do_not_look_at(spark, tmp_path, monkeypatch, name, a_file):
    seen = []
    monkeypatch.setattr(catalogue, "written", lambda df, _: seen.append(df) or df)
    catalogue.QUERIES[name](spark, corpus_of_ids(spark, tmp_path, 64))
    assert 0 < seen[0].count() <= 64 * a_file and "text" not in seen[0].columns
