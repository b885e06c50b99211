"""Plan-shape guards: the properties PLANS.md relies on stay true."""

import pytest

from conftest import SF_SMALL
from kbpipe.plans.ingest import knowledge_points
from kbpipe.plans.registry import QUERIES
from kbpipe.sources.fixtures import Fixtures
from kbpipe.sources.tables import Tables


def optimized(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


def executed(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,max_replace,max_extract", [
    ("redact_documents", 10, 6),        # 6 token steps + 4 context rules; the sweep cuts text and names into words
    ("discovered_names", 10, 4),
    ("chunk_min_length", 20, 10),       # whole-document name pass + chunk pass
    ("chunk_paragraphs_parity", 11, 6),
    ("html_main_text", 5, 2),           # the numeric entities
    ("page_links", 3, 2),
])
def test_each_regex_stage_once(spark, name, max_replace, max_extract):
    p = optimized(spark, name)
    assert p.count("regexp_replace") <= max_replace
    assert p.count("regexp_extract_all") <= max_extract


def test_embedding_udf_runs_once_and_top_k_limits_before_shuffle(spark):
    points = knowledge_points(Tables(spark, SF_SMALL).documents, "run")
    plan = points._jdf.queryExecution().executedPlan().toString()
    # the name sweep and the embedder, each evaluated by one node
    nodes = [line for line in plan.split("\n") if "ArrowEvalPython [" in line]
    assert len(nodes) == 2 and sum("dense(" in n for n in nodes) == 1 and sum("_sweep(" in n for n in nodes) == 1
    p = executed(spark, "rag_prompt")
    # cells packed once, scored once; the question blocks are a join side, not a driver loop
    assert p.count("MapInArrow") == 2 and p.count("FlatMapGroupsInArrow") == 1
    assert "WindowGroupLimit" in p and "Partial" in p


def test_answers_search_the_stored_table(spark):
    p = executed(spark, "rag_prompt")
    assert p.count("ReadSchema: struct<id:string,vector:array<float>,text:string,source:string>") == 1
    assert "documents.parquet" not in p and "regexp_extract_all" not in p


def test_filters_and_pruning_reach_the_scan(spark):
    p = executed(spark, "question_check")
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p
    p = Fixtures(spark, SF_SMALL).costs()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in p and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in p
    p = executed(spark, "request_alert")
    assert "ReadSchema: struct<ts:timestamp_ntz>" in p


def test_frontier_pre_aggregates_before_its_shuffle(spark):
    p = executed(spark, "frontier")
    assert p.count("HashAggregate(keys=[url") >= 2
    # without a broadcast, too: the anti join must not slip under the distinct
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links_side = executed(spark, "frontier").split("SortMergeJoin")[1].split("Generate")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert links_side.count("HashAggregate(keys=[url") == 2 and links_side.count("Exchange") == 1
