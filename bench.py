"""Headline timings. Prints one JSON line; each figure is the median of three warm runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from gleanery.catalog import fixtures
from gleanery.operators import bm25, crawl_log, extract, frontier, fusion, index, merge, vector, workspace
from gleanery.session import local_session, scratch_path, spread
from gleanery.sources import pages as P
from gleanery.sources.index_store import read_index, write_index

RUNS = 3


def drain(df):
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    def view(name):
        return fixtures.view(spark, sf_dir, name)

    corpus, queries = view("v_corpus"), view("v_queries")
    stored = write_index(index.build_index(corpus, stage=True), scratch_path(spark, "bench-index"))
    path = stored.docs.inputFiles()[0].rsplit("/docs/", 1)[0]

    # embeddings are stored rows, as a search finds them
    vectors_path = scratch_path(spark, "bench-vectors")
    vector.embed_pages(corpus.select(F.col("doc_id").alias("id"), "content")).write.parquet(vectors_path)
    asked_path = scratch_path(spark, "bench-asked")
    vector.embed(queries, "query_id", "q").write.parquet(asked_path)
    text_vectors, asked = spark.read.parquet(vectors_path), spark.read.parquet(asked_path)

    def hybrid():
        left = bm25.bm25_search(read_index(spark, path), queries, k=10)
        right = vector.vector_search(text_vectors, asked, k=10).withColumnRenamed("page_id", "doc_id")
        return bm25.top_k(fusion.rrf_fuse(left, right, key="doc_id"), 10)

    seeds = view("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("url"))
    jobs = {
        "index_build": lambda: index.build_index(corpus).postings,
        "index_write": lambda: write_index(index.build_index(corpus, stage=True), scratch_path(spark, "bench-write"), False).field_stats,
        "bm25_top10_stored": lambda: bm25.bm25_search(read_index(spark, path), queries, k=10),
        "bm25_top10_from_text": lambda: bm25.bm25_search(index.build_index(corpus, stage=True), queries, k=10),
        "vector_top10": lambda: vector.vector_search(text_vectors, asked, k=10),
        "hybrid_rrf_top10": hybrid,
        "extract_light": lambda: extract.extract_pages(spread(view("pages"))),
        "extract_dom": lambda: extract.extract_pages(spread(view("pages")), lightweight=False),
        "upsert_pages": lambda: P.upsert_pages(view("v_crawled"), view("v_page_batch")),
        "expand_frontier": lambda: frontier.expand_frontier(view("v_edges"), seeds, max_depth=4),
        "politeness_wait": lambda: crawl_log.politeness_wait(view("v_fetch_log")),
        "bulk_add_items": lambda: workspace.bulk_add_items(view("v_bulk_existing"), view("v_bulk_requests"), cap=60),
        "facet": lambda: merge.facet(view("v_results")),
        "transfer_sources": lambda: merge.collect_transfer_sources(view("v_results"), view("v_results"), view("v_results")),
    }
    only = os.environ.get("BENCH_ONLY", "")
    timings = {}
    for name, job in jobs.items():
        if only and name not in only.split(","):
            continue
        drain(job())
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            drain(job())
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "sum of median warm seconds of the headline queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": cpus,
        "spark": spark.version, "driver_memory": spark.conf.get("spark.driver.memory"),
    }))


if __name__ == "__main__":
    main()
