"""What the plans must look like, whatever the data."""

import os
import re

import pytest

from codeloom.operators import facts, lines
from codeloom.plans import catalogue
from codeloom.plans.code_corpus import code_corpus

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lang_by_ext", "extension_lookups", "path_ignored", "ignored_regions", "suppressions", "line_table"])
def test_line_and_registry_queries_stay_in_the_jvm(spark, name):
    assert not re.search("EvalPython|MapInArrow|MapInPandas|PythonUDTF", plan(catalogue.QUERIES[name](spark, SF)))


def test_scan_reads_one_column(spark):
    assert "ReadSchema: struct<doc_id:bigint>" in plan(catalogue.QUERIES["lang_by_ext"](spark, SF))


def test_language_filter_is_below_the_parse(spark):
    p = plan(facts.facts(code_corpus(spark, SF).where("language = 'c'"), ("imports",)))
    assert p.index("MapInArrow") < p.index("Filter")


def test_projection_of_facts_does_not_shuffle(spark):
    assert "Exchange" not in plan(facts.call_edges(facts.facts(code_corpus(spark, SF))))


def test_markers_shuffle_once_by_file(spark):
    p = plan(lines.ignored_regions(code_corpus(spark, SF)))
    assert p.count("Exchange hashpartitioning(file_id") == 1 and p.count("Exchange") == 1
