"""Registered queries: streams run over the tables to their end."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.catalog import fixtures
from gleanery.catalog.registry import ORACLES, QUERIES
from gleanery.catalog.retrieval_queries import _BM25, _ranked, six_digits
from gleanery.operators.bm25 import bm25_search
from gleanery.plans.index_log import open_log
from gleanery.session import scratch_path
from gleanery.sources.page_log import newest_pages, read_log
from gleanery.streaming import progress, streams


def stream_query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; streams read files, so they take the folder itself."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = fixtures.oracle(sql)
        return fn

    return wrap


def _as_files(spark: SparkSession, sf_dir: str, view: str, files: int):
    """A view written as several files, to arrive in several micro-batches."""
    df = fixtures.view(spark, sf_dir, view)
    path = scratch_path(spark, "arrivals")
    df.repartition(files).write.parquet(path)
    return path, df.schema


@stream_query("stream_new_urls", "SELECT DISTINCT url FROM v_read_events")
def stream_new_urls(spark, sf_dir):
    path, schema = _as_files(spark, sf_dir, "v_read_events", 3)
    arrivals = streams.read_stream(spark, path, schema, files_per_trigger=1)
    return streams.run_to_table(streams.stream_new_urls(arrivals), scratch_path(spark, "urls"))


@stream_query("dedupe_within_ttl", """
WITH RECURSIVE c AS (
  SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL
  UNION ALL
  SELECT c.user_id, c.event_type, min(e.ts) FROM c JOIN events e ON e.user_id = c.user_id AND e.event_type = c.event_type
    AND e.ts >= c.t + interval '3' day GROUP BY ALL)
SELECT user_id, event_type, strftime(t, '%Y-%m-%d %H:%M:%S') AS computed_at FROM c""")
def dedupe_within_ttl(spark, sf_dir):
    """Answers cached for three days per (user, type)."""
    events = streams.read_stream(
        spark, sf_dir, fixtures.BASE_SCHEMAS["events"].replace("TIMESTAMP_NTZ", "TIMESTAMP"), name_filter="events.parquet")
    computed = streams.dedupe_within_ttl(events, ["user_id", "event_type"], "ts", 3 * 86_400)
    out = streams.run_to_table(computed, scratch_path(spark, "ttl"))
    return out.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("computed_at"))


@stream_query("stream_error_rate", """
WITH w AS (SELECT time_bucket(interval '1 day', ts) AS b, count(*) FILTER (WHERE NOT ok) AS errors, count(*) AS fetches
           FROM v_fetch_log GROUP BY 1)
SELECT strftime(b, '%Y-%m-%d') AS day, errors, fetches FROM w""")
def stream_error_rate(spark, sf_dir):
    log = streams.read_stream(
        spark, sf_dir, fixtures.BASE_SCHEMAS["events"].replace("TIMESTAMP_NTZ", "TIMESTAMP"), name_filter="events.parquet"
    ).select("ts", (F.col("event_type") != "error").alias("ok"))
    rates = streams.stream_error_rate(log, width="1 day")
    out = streams.run_to_table(rates, scratch_path(spark, "rates"), mode="complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "errors", "fetches")


@stream_query("stream_politeness", """
WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id) AS prev FROM v_fetch_log)
SELECT event_id, round(CASE WHEN prev IS NULL THEN 0 ELSE greatest(0, 3600 - (epoch_us(ts) - epoch_us(prev)) / 1e6) END, 6)
  AS wait_seconds FROM p""")
def stream_politeness(spark, sf_dir):
    log = streams.read_stream(
        spark, sf_dir, fixtures.BASE_SCHEMAS["events"].replace("TIMESTAMP_NTZ", "TIMESTAMP"), name_filter="events.parquet"
    ).select("event_id", "ts", F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"))
    waits = streams.stream_politeness(log, default_delay=3600.0)
    out = streams.run_to_table(waits, scratch_path(spark, "waits"))
    return out.select("event_id", F.round("wait_seconds", 6).alias("wait_seconds"))


def _arrivals(spark: SparkSession, df, arrival: str, parts: int, start) -> None:
    """Rows that arrive one part after the other, by the number that ``arrival`` gives.

    ``start(stream)`` takes up the stream where its checkpoint left it; it then finds the files of one part, which many
    tasks have written and read, and takes them as one micro-batch.
    """
    path = scratch_path(spark, "arrivals")
    for i in range(parts):
        df.where(f"({arrival}) = {i}").write.mode("append").parquet(path)
        start(streams.read_stream(spark, path, df.schema)).awaitTermination()


_ARRIVAL = "CASE WHEN seq >= 10000000 THEN 2 WHEN floor(seq / 2) % 2 = 0 THEN 0 ELSE seq % 2 END"


@stream_query("stream_ingest", f"""
WITH a AS (SELECT *, {_ARRIVAL} AS arrival FROM v_page_batch)
SELECT url, title, md5(content) AS digest FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival DESC, seq) = 1""")
def stream_ingest(spark, sf_dir):
    """Three arrivals with repeated URLs: the last arrival with a URL counts, and in it the first row."""
    changes = fixtures.view(spark, sf_dir, "v_page_batch")
    changes = changes.withColumn("crawled_at", F.col("crawled_at").cast("timestamp_ntz"))
    root = scratch_path(spark, "ingest")
    _arrivals(spark, changes, _ARRIVAL, 3, lambda new: streams.stream_ingest(new, f"{root}/log", f"{root}/checkpoint", available_now=True))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema if f.name != "seq")
    pages = newest_pages(read_log(spark, f"{root}/log", schema))
    return pages.select("url", "title", F.md5(F.col("content").cast("binary")).alias("digest"))


@stream_query("stream_index", f"WITH {_BM25}, {_ranked('scores', 'r', 10)} SELECT query_id, rank, doc_id, floor(score * 1e6 + 0.5e0) / 1e6 AS score FROM r")
def stream_index(spark, sf_dir):
    """Documents arrive in three micro-batches, the first two with some that later ones replace."""
    corpus = fixtures.view(spark, sf_dir, "v_corpus")
    stale = corpus.where("doc_id % 3 = 1").withColumn("content", F.concat(F.lit("stale "), "content")).withColumn("at", F.lit(0))
    arrivals = corpus.withColumn("at", F.col("doc_id") % 3).unionByName(stale)
    root = scratch_path(spark, "index-stream")
    _arrivals(spark, arrivals, "at", 3, lambda new: streams.stream_index(new.drop("at"), f"{root}/index", f"{root}/checkpoint"))
    hits = bm25_search(open_log(spark, f"{root}/index"), fixtures.view(spark, sf_dir, "v_queries"), k=10)
    return hits.withColumn("score", six_digits(F.col("score")))


@stream_query("stream_progress", """
WITH b AS (SELECT event_id % 3 AS batch, count(*) FILTER (WHERE event_type <> 'error') AS pages,
                  count(*) FILTER (WHERE event_type = 'error') AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1),
t AS (SELECT batch, sum(pages) OVER w AS pages, sum(errors) OVER w AS errors,
             (epoch_us(max(last_ts) OVER w) - epoch_us(min(first_ts) OVER w)) / 1e6 AS elapsed FROM b WINDOW w AS (ORDER BY batch))
SELECT cast(batch AS bigint) AS batch, cast(pages AS bigint) AS pages, cast(errors AS bigint) AS errors,
       cast(floor(elapsed) AS bigint) AS elapsed_secs, cast(floor(pages * 1000000 / elapsed) AS bigint) AS pages_per_million_secs FROM t""")
def stream_progress(spark, sf_dir):
    """Three arrivals of the fetch log, in no order of time; totals after each."""
    events = spark.read.schema(fixtures.BASE_SCHEMAS["events"].replace("TIMESTAMP_NTZ", "TIMESTAMP")).parquet(f"{sf_dir}/events.parquet")
    log = events.select("event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    root = scratch_path(spark, "progress")
    _arrivals(spark, log, "event_id % 3", 3, lambda new: progress.stream_progress(new, f"{root}/log", f"{root}/checkpoint", available_now=True))
    return progress.progress(spark, f"{root}/log").select(
        "batch", "pages", "errors", F.floor("elapsed_secs").alias("elapsed_secs"),
        F.floor(F.col("pages") * 1000000 / F.col("elapsed_secs")).alias("pages_per_million_secs"))
