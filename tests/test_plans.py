"""Plan-shape guards for the scale properties the design relies on."""

import re

import pytest

import __spark_entry__ as E
from roundlearn.plans import registry
from conftest import SF_SMALL

QUERIES = {k: f for k, f in E.queries().items() if k in registry.QUERIES}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_products_and_no_row_python(spark, key):
    p = plan(QUERIES[key](spark, SF_SMALL))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p), key
    # heads are scored by one Arrow-batched matrix product (MapInPandas)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas", p), key


def test_split_is_a_narrow_projection(spark):
    p = plan(QUERIES["split_three_way"](spark, SF_SMALL))
    assert "Exchange" not in p and "Join" not in p
    assert "ReadSchema: struct<event_id:bigint>" in p          # column pruning reaches the scan


def test_scoring_has_no_join(spark):
    p = plan(QUERIES["score_by_heads"](spark, SF_SMALL))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_filter_pushed_to_scan(spark):
    p = plan(QUERIES["class_equals"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p


def test_text_scan_reads_only_needed_columns(spark):
    p = plan(QUERIES["tokenise_hash"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_cap_windows_only_edge_rows_behind_a_broadcast_lookup(spark):
    p = plan(QUERIES["stratified_cap"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
