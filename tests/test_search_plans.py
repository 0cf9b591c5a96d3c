"""Searches of many questions sum scores inside cells: no plan sums the parts of pairs of question and document across a shuffle."""

import re

import pytest

import __spark_entry__

NAMES = ["comparison_fusion", "graph_merge", "fts_index_search", "build_sources", "bm25_score", "code_arm_nary", "graph_reserve", "graph_partition", "bundle_search", "flatten_union", "flatten_rank"]


@pytest.mark.parametrize("name", NAMES)
def test_no_sum_over_pairs(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not re.search(r"partial_sum\([^\n]*\btf#", plan)
