"""Registered queries: page table reads, upserts and state changes."""

from pyspark.sql import functions as F

from gleanery.catalog.registry import query
from gleanery.session import scratch_path
from gleanery.sources import pages as P

_STATE = "id, url, title, md5(content) AS digest, indexed"


def _state(df):
    return df.select("id", "url", "title", F.md5(F.col("content").cast("binary")).alias("digest"), "indexed")


@query("read_pages", f"SELECT {_STATE} FROM v_crawled ORDER BY id")
def _(view):
    crawled = view("v_crawled").withColumn("crawled_at", F.col("crawled_at").cast("timestamp_ntz"))
    spark = crawled.sparkSession
    path = scratch_path(spark, "pages")
    P.write_snapshot(crawled, path)
    return _state(P.read_pages(spark, path))


@query("unindexed_batch", f"SELECT {_STATE} FROM v_crawled WHERE NOT indexed ORDER BY id")
def _(view):
    return _state(P.unindexed_batch(view("v_crawled")))


@query("unindexed_pages", f"SELECT {_STATE} FROM v_crawled WHERE NOT indexed")
def _(view):
    return _state(P.unindexed_batch(view("v_crawled"), limit=None))


@query("upsert_pages", """
WITH b AS (SELECT * FROM v_page_batch QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
SELECT c.id, coalesce(b.url, c.url) AS url, CASE WHEN b.url IS NULL THEN c.title ELSE b.title END AS title,
       md5(CASE WHEN b.url IS NULL THEN c.content ELSE b.content END) AS digest,
       CASE WHEN b.url IS NULL THEN c.indexed ELSE b.indexed END AS indexed
FROM v_crawled c FULL JOIN b ON c.url = b.url""")
def _(view):
    return _state(P.upsert_pages(view("v_crawled"), view("v_page_batch")))


@query("upsert_embeddings", """
WITH b AS (SELECT vec_id AS page_id, 0 AS chunk_index, list_reverse(embedding) AS embedding FROM embeddings WHERE label >= 5)
SELECT coalesce(b.page_id, e.page_id) AS page_id, coalesce(b.chunk_index, e.chunk_index) AS chunk_index,
       round(coalesce(b.embedding, e.embedding)[1]::DOUBLE, 6) AS first_value
FROM v_page_embeddings e FULL JOIN b ON e.page_id = b.page_id AND e.chunk_index = b.chunk_index""")
def _(view):
    batch = view("embeddings").where("label >= 5").select(
        F.col("vec_id").alias("page_id"), F.lit(0).alias("chunk_index"), F.reverse("embedding").alias("embedding"))
    out = P.upsert_embeddings(view("v_page_embeddings"), batch)
    return out.select("page_id", "chunk_index",
                      F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"))


@query("insert_ignore", """
SELECT url, title FROM v_crawled UNION ALL
SELECT url, title FROM (SELECT * FROM v_page_batch QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1) b
WHERE url NOT IN (SELECT url FROM v_crawled)""")
def _(view):
    return P.insert_ignore(view("v_crawled"), view("v_page_batch")).select("url", "title")


@query("append_activity", """
SELECT id, session_id, action_type, details FROM v_activity
UNION ALL SELECT o_orderkey + 100000000, cast(o_custkey AS varchar), 'search',
  '{"query":"' || o_orderpriority || '"}' FROM orders""")
def _(view):
    new = view("orders").select(
        (F.col("o_orderkey") + 100000000).alias("id"), F.col("o_custkey").cast("string").alias("session_id"),
        F.lit("search").alias("action_type"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("query"))).alias("details"),
        F.col("o_orderdate").alias("created_at"))
    return P.append_activity(view("v_activity"), new).drop("created_at")


@query("pages_missing_embeddings", """
SELECT id, url FROM v_crawled c WHERE indexed AND NOT EXISTS (SELECT 1 FROM v_page_embeddings e WHERE e.page_id = c.id)""")
def _(view):
    return P.pages_missing_embeddings(view("v_crawled"), view("v_page_embeddings")).select("id", "url")


@query("urls_already_crawled", "SELECT DISTINCT url FROM v_page_batch WHERE url IN (SELECT url FROM v_crawled)")
def _(view):
    return P.urls_already_crawled(P.distinct_urls(view("v_page_batch")), view("v_crawled"))


@query("mark_indexed", """
SELECT id, indexed OR id IN (SELECT vec_id FROM embeddings) AS indexed FROM v_crawled""")
def _(view):
    return P.mark_indexed(view("v_crawled"), view("embeddings").select(F.col("vec_id").alias("id"))).select("id", "indexed")


@query("page_counts", """
SELECT (SELECT count(*) FROM v_crawled) AS total_pages, (SELECT count(*) FROM v_crawled WHERE indexed) AS indexed_pages,
       (SELECT count(*) FROM embeddings) AS embeddings""")
def _(view):
    return P.page_counts(view("v_crawled"), view("v_page_embeddings"))


@query("shard_doc_counts")
def _(view):
    return P.shard_doc_counts(view("v_crawled"), 6)


@query("shard_doc_total", "SELECT count(*) AS docs, 8 AS shards FROM v_crawled")
def _(view):
    counts = P.shard_doc_counts(view("v_crawled"), 6)
    return counts.agg(F.sum(F.when(F.col("shard") != "total", F.col("docs"))).alias("docs"),
                      F.count_if(F.col("shard") != "total").cast("int").alias("shards"))


@query("distinct_urls", "SELECT DISTINCT url FROM v_page_batch")
def _(view):
    return P.distinct_urls(view("v_page_batch"))


@query("reset_index_state", "SELECT id, FALSE AS indexed FROM v_crawled")
def _(view):
    from gleanery.plans.indexing import reset_index_state

    return reset_index_state(view("v_crawled"), view("v_page_embeddings"))[0].select("id", "indexed")
