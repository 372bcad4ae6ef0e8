"""Every named query has SQL to compare with, and a sample of them agrees on the smallest tables."""

import pytest

from pagemill import catalog
from tests.conftest import SF_DIR
from tools.check import compare, connect

SAMPLE = ["page_main_text", "ext1_tokens", "ext2_depth", "ext7_strip_elements", "ext13_links", "cls9_docs_framework", "w1_anchors", "w3_asset_names",
          "j5_unused_assets", "rt2_richtext_html", "rt6_delta", "mdp2_blank_lines", "cln3_anchor_lists", "out2_index_document", "u1_crawl_list"]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_scan_reads_only_what_it_needs_and_shuffles_once(spark):
    from pagemill.operators import regions
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    plan = regions.strip_elements(pages, ["nav"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<page_id:bigint,html:string>" in plan


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    ok, message = compare(spark, connect(SF_DIR), name, SF_DIR, catalog.queries()[name], catalog.oracles()[name])
    assert ok, message


def test_page_scan_agrees_with_sql(spark):
    ok, message = compare(spark, connect(SF_DIR), "src1_page_scan", SF_DIR, catalog.queries()["src1_page_scan"], catalog.oracles()["src1_page_scan"])
    assert ok, message
