"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from gleanery.catalog import fixtures, registry
from gleanery.operators import bm25, extract, index
from gleanery.plans import search
from gleanery.sources.index_store import write_index

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    corpus = fixtures.view(spark, SF, "v_corpus")
    return write_index(index.build_index(corpus, stage=True), str(tmp_path_factory.mktemp("ix") / "ix"), buckets=4)


def test_search_prunes_buckets_and_limits_early(spark, stored):
    text = plan(bm25.bm25_search(stored, fixtures.view(spark, SF, "v_queries"), k=10))
    assert "dynamicpruning" in text and "WindowGroupLimit" in text and "BroadcastHashJoin" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_every_stored_table_is_read_by_bucket(spark, stored):
    """Statistics, positions, counts and documents: only the buckets that a search names are read."""
    asked = fixtures.view(spark, SF, "v_queries")
    terms = bm25.query_terms(asked)
    hits = bm25.bm25_search(stored, asked, k=3)
    for df in (bm25.term_statistics(stored, terms), bm25.read_terms(stored.positions, terms, stored, "t"), bm25.match_counts(stored, asked),
               search.with_documents(hits, stored)):
        assert "dynamicpruning" in plan(df)


def test_term_counting_adds_no_shuffle(spark):
    text = plan(index.build_index(fixtures.view(spark, SF, "v_corpus")).postings)
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1


def test_light_extraction_is_shuffle_free_and_pruned(spark):
    text = plan(extract.extract_pages(fixtures.view(spark, SF, "pages")).select("page_id", "title"))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    columns = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert columns == "page_id:bigint,html:string"


def test_filters_reach_the_scan(spark):
    text = plan(fixtures.view(spark, SF, "v_items").where(F.col("workspace_id") == 3).select("item_id"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_custkey,3\)", text)


@pytest.mark.parametrize("name", ["coalescing_upsert", "station_stats", "collect_transfer_sources", "latest_overview"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    text = plan(registry.load()[0][name](spark, SF))
    assert "partial_" in text


def test_no_registered_query_uses_a_cartesian_product(spark):
    for name in ("crawl_summary", "page_counts", "facet", "robots_allows", "upsert_pages", "bm25_search"):
        text = plan(registry.load()[0][name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
