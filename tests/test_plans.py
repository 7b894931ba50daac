"""Plans: what reaches the scan, what is shuffled."""

import re

import pytest

from tessera import catalogue

TINY = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, TINY)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["token_estimate", "content_hash", "decay_scores", "confidence_tiers", "sanitize", "code_ref_queue"])
def test_projections_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "hashpartitioning" not in text


@pytest.mark.parametrize("name", ["list_filtered", "heatmap_two_stage", "vector_topk", "high_value_recent", "bm25_topk"])
def test_rankings_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_columns_are_pruned(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint>", plan(spark, "status_counts"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(spark, "token_estimate"))
    assert "text" not in re.search(r"ReadSchema: (struct<[^>]*>)", plan(spark, "effective_score_topk"))[1]


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ts", plan(spark, "incremental_scan"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id,7\)", plan(spark, "events_of_session"))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(spark, name)
